"""The commands over small tables."""

import pytest

from tessera.__main__ import main
from tessera.sources import container as C


def test_commands(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    main(["query", "vector_counts", "/root/testdata/sf0.001", at("q")], spark)
    assert spark.read.parquet(at("q")).count() == 200
    spark.createDataFrame([("a", 0, "I", None, None, b"1", b"22", b"333")], C.PACKETS).write.parquet(at("p"))
    main(["split", at("p"), at("s"), "--highest", "1"], spark)
    row = spark.read.parquet(at("s")).first()
    assert row.layer2 is None and bytes(row.layer1) == b"22" and capsys.readouterr().out.split() == ["1", "3", "3"]
    frames = [(k, 2, 2, 25, bytes([k] * 4), b"u", b"v") for k in range(40)]
    spark.createDataFrame(frames, "frame_no long, width int, height int, fps int, y binary, cb binary, cr binary").write.parquet(at("f"))
    main(["y4m", at("f"), at("clip")], spark)
    main(["frames", at("clip"), at("g")], spark)
    assert sorted((r.frame_no, bytes(r.y)) for r in spark.read.parquet(at("g")).collect()) == [(k, bytes([k] * 4)) for k in range(40)]
    spark.createDataFrame([(0, [1, 2])], "frame long, coef array<int>").write.parquet(at("l"))
    main(["compare", at("l"), at("l")], spark)
    assert "100.0" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["split", at("p"), at("t"), "--highest", "3"], spark)
