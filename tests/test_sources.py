import io
import random

import pytest
from pyspark.sql import functions as F

from sourcemeld.operators.profile import column_types, profile
from sourcemeld.sources.readers import Quotes, admission, manifest, read_csv, read_folder, read_parquet


def test_csv_rows_lineage_and_missing_tokens(spark, tmp_path):
    (tmp_path / "a b.csv").write_text('id,note,empty\n001,"two\nlines",NA\n2,"say ""hi""",null\n', encoding="utf-8")
    rows = read_csv(spark, str(tmp_path / "a b.csv")).orderBy("source_row_number").collect()
    assert [(r.id, r.note, r.empty, r.source_file, r.source_row_number) for r in rows] == [
        ("001", "two\nlines", None, "a b.csv", 2), ("2", 'say "hi"', None, "a b.csv", 3),
    ]
    assert rows[0].record_id == "a b.csv#000000000002"


@pytest.mark.parametrize("multi_line", [True, False])
def test_row_numbers_over_many_splits(spark, tmp_path, multi_line):
    for name, n in (("x.csv", 5000), ("y.csv", 7000)):
        (tmp_path / name).write_text("v\n" + "".join(f"{i}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        df = read_csv(spark, str(tmp_path), multi_line=multi_line)
        wrong = df.where(F.col("v").cast("long") + 2 != F.col("source_row_number")).count()
        assert (wrong, df.count(), df.select("record_id").distinct().count()) == (0, 12000, 12000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_parquet_row_numbers(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = read_parquet(spark, str(tmp_path / "t"))
    assert df.where(F.col("id").cast("long") + 2 != F.col("source_row_number")).count() == 0


def test_admission(spark, tmp_path):
    for name in ("a.csv", "b.XLSX", "c.json", "noext"):
        (tmp_path / name).write_text("x")
    found = {r.source_file: (r.accepted, r.readable) for r in manifest(spark, str(tmp_path)).collect()}
    assert found == {"a.csv": (True, True), "b.XLSX": (True, False), "c.json": (False, False), "noext": (False, False)}
    reasons = {r.source_file: r.reason for r in admission(spark.createDataFrame([("/d/c.json",)], "path string")).collect()}
    assert reasons == {"c.json": "Unsupported file type: .json"}


def test_type_inference_over_all_rows(spark):
    rows = [("1", "1", "true", "2024-01-02", "2024-01-02T10:00:00", "0123", None), ("22", "2.5", "False", "03/04/2024", "2024-01-02", "7", "")]
    df = spark.createDataFrame([(f"f{i}", i + 2, *r) for i, r in enumerate(rows)], "source_file string, source_row_number long, i string, n string, b string, d string, t string, z string, u string")
    one = df.withColumn("source_file", F.lit("f"))
    assert {r.column: r.inferred_type for r in column_types(one).collect()} == {
        "i": "integer", "n": "number", "b": "boolean", "d": "date", "t": "datetime", "z": "string", "u": "unknown",
    }


def test_samples_are_the_first_non_null_values(spark):
    df = spark.createDataFrame([("f", i + 2, None if i % 2 else str(i)) for i in range(300)], "source_file string, source_row_number long, v string")
    row = profile(df.repartition(3)).first()
    assert row.samples == ["0", "2", "4", "6", "8"] and (row.n_rows, row.n_nulls) == (300, 150)


def test_samples_reach_beyond_the_head_of_a_file(spark):
    df = spark.createDataFrame([("f", i + 2, None if i < 250 else str(i)) for i in range(300)], "source_file string, source_row_number long, v string")
    assert profile(df.repartition(3)).first().samples == ["250", "251", "252", "253", "254"]


def test_equal_file_names_keep_their_folders(spark, tmp_path):
    for folder, rows in (("x", "1,a\n2,b\n"), ("y", "3,c\n4,d\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "crm.csv").write_text("id,name\n" + rows)
    with pytest.raises(ValueError, match="crm.csv"):
        read_csv(spark, [str(tmp_path / "x"), str(tmp_path / "y")])
    got = read_csv(spark, [str(tmp_path / "x"), str(tmp_path / "y")], root=str(tmp_path)).collect()
    assert sorted((r.id, r.record_id) for r in got) == [(str(i), f"{'xxyy'[i - 1]}/crm.csv#{2 + (i - 1) % 2:012d}") for i in range(1, 5)]


def test_ids_do_not_depend_on_what_is_read_along(spark, tmp_path):
    for day in ("day1", "day2"):
        (tmp_path / day).mkdir()
        (tmp_path / day / "crm.csv").write_text(f"id,name\n1,{day}\n")
    (tmp_path / "day2" / "hr.csv").write_text("id,name\n9,z\n")
    root = str(tmp_path)
    alone = {r.record_id for r in read_csv(spark, f"{root}/day1/crm.csv", root=root).collect()}
    for paths, more in (([f"{root}/day1", f"{root}/day2"], {}), (f"{root}/*/*.csv", {}), (root, {"recursiveFileLookup": True})):
        for multi_line in (None, True):
            ids = {r.record_id for r in read_csv(spark, paths, multi_line, root=root, **more).collect()}
            assert alone < ids and ids == {f"{f}#000000000002" for f in ("day1/crm.csv", "day2/crm.csv", "day2/hr.csv")}
    own = {r.record_id for r in read_csv(spark, f"{root}/day2").collect()}
    assert own == {"crm.csv#000000000002", "hr.csv#000000000002"}
    assert {r.record_id for r in read_csv(spark, f"{root}/day2/hr.csv").collect()} < own


def quoted_file(rng, rows, names):
    """A CSV text with line ends, quotes and separators inside quotes, and what a reader makes of it."""
    pieces = ["a", "bc", "", " ", ",", "\n", "\n\n", '"', "\r\n", "5\" pipe", "ü", '","', "x" * 40]
    want, out = [], io.StringIO()
    out.write(",".join(names) + "\n")
    for _ in range(rows):
        cells = ["".join(rng.choice(pieces) for _ in range(rng.randrange(4))) for _ in names]
        cells[0] = cells[0] or "k"
        want.append(cells)
        plain = lambda c: not set(c) & set(',\n\r') and not c.startswith('"')
        out.write(",".join(c if plain(c) and rng.random() < 0.7 else '"' + c.replace('"', '""') + '"' for c in cells))
        out.write(rng.choice(["\n", "\n", "\n\n", "\r\n"]))
    return out.getvalue(), want


@pytest.mark.parametrize("split", [60, 300, 100_000])
def test_quoted_line_ends_over_many_splits(spark, tmp_path, split):
    rng = random.Random(split)
    want = {}
    for name, names in (("a.csv", ["id", "x", "y"]), ("b.csv", ["id", "x", "y"]), ("sub/c.csv", ["u", "v"]), ("empty.csv", None), ("head.csv", ["u", "v"])):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        text, rows = ("", []) if names is None else quoted_file(rng, 0 if name == "head.csv" else 40, names)
        (tmp_path / name).write_bytes(("\ufeff" * (name == "a.csv") + text).encode())
        want |= {(name, i + 2): [c or None for c in row] for i, row in enumerate(rows)}
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, str(split))
        frames = read_folder(spark, [str(tmp_path), str(tmp_path / "sub")], root=str(tmp_path))
        assert sorted(f.columns[:-3] for f in frames) == [["id", "x", "y"], ["u", "v"]]
        got = {(r.source_file, r.source_row_number): list(r)[:-3] for f in frames for r in f.collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == want


def test_lines_know_where_they_end():
    def plain(text, inside):
        start, i = not inside, 0
        while i < len(text):
            c = text[i]
            if inside:
                if c == '"' and text[i + 1 : i + 2] == '"':
                    i += 1
                elif c == '"':
                    inside, start = False, False
            elif c == '"' and start:
                inside = True
            start = c == "," and not inside
            i += 1
        return inside

    rng = random.Random(8)
    for _ in range(300):
        texts = ["".join(rng.choice('a,"" ') for _ in range(rng.randrange(9))) for _ in range(12)]
        for begin, got in zip((False, True), Quotes().states(texts)):
            state = begin
            for t, g in zip(texts, got):
                state = plain(t, state)
                assert state == g, (texts, begin)


def test_a_large_quoted_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "big.csv").write_text("id,note\n" + "".join(f'{i},"two\nlines {i}"\n' for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        df = read_csv(spark, str(tmp_path / "big.csv"))
        assert df.where("note <> concat('two\nlines ', id) or source_row_number <> id + 2").count() == 0
        assert df.count() == 3000
        assert spark.read.text(str(tmp_path / "big.csv")).rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_unequal_headers_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,ann\n")
    (tmp_path / "b.csv").write_text("name,id\nbob,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, str(tmp_path), multi_line=False).collect()


def test_csv_folders_are_written_by_many_tasks(spark, tmp_path):
    """Names clash between folders although several tasks write."""
    from collections import Counter
    from pathlib import Path

    from sourcemeld.session import scratch_root
    from workload.cleaning import QUERIES

    rows = spark.range(200).selectExpr("id as c_custkey", "concat('n', id) as c_name", "cast(id % 25 as int) as c_nationkey")
    rows.repartition(4).write.parquet(f"{tmp_path}/customer.parquet")
    seen = set(Path(scratch_root(spark)).glob("*/csv"))
    out = QUERIES["csv_folders"](spark, str(tmp_path)).collect()
    assert sorted((r["folder"], r["n_rows"], r["n_ids"], r["n_places"]) for r in out) == [(f"zone={k}", 40, 40, 40) for k in range(5)]
    (root,) = set(Path(scratch_root(spark)).glob("*/csv")) - seen
    names = Counter(p.name for p in root.glob("*/*.csv"))
    assert len(names) > 1 and max(names.values()) > 1
