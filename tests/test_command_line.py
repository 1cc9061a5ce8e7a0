import json

from strataweave.__main__ import main
from strataweave.plans import archives
from strataweave.sources import msgpack_rows as m


def table(*rows):
    return m.build_table([m.pack_value(r) for r in rows])


def test_commands(spark, tmp_path, capsys):
    one = {"t.uasset": b"h", "t.uexp": table({"m_id": 1, "x": 1}), "a.txt": b"1"}
    two = {"t.uasset": b"h", "t.uexp": table({"m_id": 1, "x": 2}), "a.txt": b"2"}
    paths = archives.demo_archives(spark, [one, two])
    assert main(["inspect", paths[0]]) == 0
    assert "t.uexp" in capsys.readouterr().out
    assert main(["analyze", *paths, "--out", str(tmp_path / "plan")]) == 0
    planned = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert planned["conflicts"] == 2
    out = f"file://{tmp_path}/out"
    assert main(["merge", *paths, "--out", out]) == 1
    assert "without a choice" in capsys.readouterr().err
    assert main(["merge", *paths, "--out", out, "--plan-id", planned["plan_id"], "--prefer", "1"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["entries"] == 3
    assert main(["verify", f"{out}/merged_P.pak"]) == 0
    back = spark.read.format("overlay_archive").load(out)
    assert {r.path: bytes(r.content) for r in back.collect()} == two
