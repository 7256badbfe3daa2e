"""Records of files cut at any byte."""

import pyarrow as pa
import pytest

from garimpo.sources import blocks, files
from garimpo.sources.rawload import split_fields

RECORDS = [
    ["1", "01/02/2020", "texto", "UTI", "H"],
    ["2", "x", 'com "aspas" e\nlinha; nova\r\nfim', "", "São João"],
    ["3", "", "\n\n", '"', ""],
    ["4", "", "", "", ""],
]


def written(sep="\n"):
    quote = lambda f: '"' + f.replace('"', '""') + '"' if any(c in f for c in '";\n') else f
    return sep.join(";".join(quote(f) for f in r) for r in [["a", "b", "c", "d", "e"], *RECORDS]) + sep


@pytest.mark.parametrize("size", [7, 16, 33, 4096])
@pytest.mark.parametrize("sep", ["\n", "\r\n"])
def test_a_file_cut_anywhere_gives_the_rows_of_the_whole(spark, tmp_path, size, sep):
    (tmp_path / "n.csv").write_text(written(sep), newline="")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = blocks.read_fields(spark, str(tmp_path / "n.csv"), ["a", "b", "c", "d", "e"])
        assert sorted(list(r)[1:] for r in got.collect()) == RECORDS
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_notes_short_long_and_missing(spark, tmp_path):
    (tmp_path / "n.csv").write_text('CD;Texto\n1;NA\n2\n3;a;b\n"4";"x;""y"""\n\n')
    assert sorted(map(tuple, files.read_notes(spark, str(tmp_path / "n.csv"), ["CD", " Texto"]).collect()), key=repr) == [("1", None), ("2", None), ("4", 'x;"y"'), (None, None)]
    (tmp_path / "leer.csv").write_text("")
    assert blocks.read_records(spark, str(tmp_path / "leer.csv")).count() == 0


def test_fields_of_a_batch():
    count, columns = split_fields(pa.array(['"a""b";c', None, "x", '"q', 'é;"";z']).slice(0), 2)
    assert count.tolist() == [2, 1, 1, -1, 3] and columns[0].to_pylist() == ['a"b', "", "x", None, "é"] and columns[1].to_pylist() == ["c", None, None, None, ""]
    assert split_fields(pa.array([], pa.string()), 2)[1][0].to_pylist() == []
