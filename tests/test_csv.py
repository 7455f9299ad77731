"""CSV dialect, ragged records and headers; two-phase duplicates."""

import pytest
from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.operators.quality import CORRUPT, RECORD, SchemaError, column_problems, duplicate_rows
from churnlens.plans.inputs import s_raw
from churnlens.sources import raw as RAW

from .conftest import SF001


@pytest.fixture(scope="module")
def lines(spark):
    rows = s_raw(spark, SF001).select(*S.RAW_COLUMNS).limit(6).collect()
    return [",".join("" if v is None else str(v) for v in r) for r in rows]


def write(path, lines, header=",".join(S.RAW_COLUMNS), end="\n"):
    path.write_text(end.join([header, *lines]) + end, encoding="utf-8")
    return str(path)


def problems(spark, path, **kw):
    return sorted((r["column"], r["check"], r["value"], r["n"]) for r in RAW.csv_problems(spark, path, **kw).collect())


def test_sound_file_in_either_mode(spark, tmp_path, lines):
    for end in ("\n", "\r\n"):
        path = write(tmp_path / f"ok{len(end)}.csv", [*lines, "", lines[0]], end=end)
        for multiline in (True, False):
            assert problems(spark, path, multiline=multiline) == []
            assert RAW.read_raw_csv(spark, path, multiline).count() == 7
            assert CORRUPT not in RAW.load_treated(spark, path, multiline).columns


def test_ragged_records_are_reported_and_raise(spark, tmp_path, lines):
    long, short = lines[0] + ",x", ",".join(lines[1].split(",")[:-3])
    path = write(tmp_path / "ragged.csv", [long, long, short, *lines[2:]])
    assert problems(spark, path) == [(RECORD, "long record", long, 2), (RECORD, "short record", short, 1)]
    with pytest.raises(SchemaError, match="long record: .* short record|short record: .*long record|record") as e:
        RAW.load_treated(spark, path)
    assert e.value.problems.count() == 2
    with pytest.raises(Exception, match="malformed record"):
        RAW.read_raw_csv(spark, path).count()  # even a count that needs no column
    with pytest.raises(Exception, match="malformed record"):
        RAW.read_raw_csv(spark, path).select("tenure").collect()


def test_quotes_and_line_feeds_are_read_right(spark, tmp_path, lines):
    odd = ['"a ""quoted"", id"' + lines[0][lines[0].index(","):], '"two\nlines"' + lines[1][lines[1].index(","):], '"back\\slash\\"' + lines[2][lines[2].index(","):]]
    path = write(tmp_path / "quoted.csv", [*odd, *lines[3:]])
    assert problems(spark, path) == []
    ids = {r[S.ID] for r in RAW.load_treated(spark, path).collect()}
    assert {'a "quoted", id', "two\nlines", "back\\slash\\"} <= ids and len(ids) == 6
    # split by lines, the record with a line feed is two malformed ones, and says so
    found = problems(spark, path, multiline=False)
    assert {(c, k) for c, k, _, _ in found} == {(RECORD, "open quote")} or (RECORD, "open quote") in {(c, k) for c, k, _, _ in found}
    with pytest.raises(SchemaError):
        RAW.load_treated(spark, path, multiline=False)


def test_headers(spark, tmp_path, lines):
    twice = write(tmp_path / "twice.csv", [x + ",Male" for x in lines], ",".join([*S.RAW_COLUMNS, "gender"]))
    assert problems(spark, twice) == [("gender.1", "unexpected", None, None)]
    with pytest.raises(SchemaError, match="gender.1 unexpected"):
        RAW.read_raw_csv(spark, twice)
    nameless = write(tmp_path / "nameless.csv", [x + ",1" for x in lines], ",".join([*S.RAW_COLUMNS, ""]))
    assert problems(spark, nameless) == [("column 22", "unexpected", None, None)]
    folder = tmp_path / "many"
    folder.mkdir()
    write(folder / "a.csv", lines[:3])
    write(folder / "b.csv", lines[3:], ",".join(reversed(S.RAW_COLUMNS)))
    with pytest.raises(Exception, match="header"):
        RAW.read_raw_csv(spark, str(folder)).collect()
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    assert {k for _, k, _, _ in problems(spark, str(empty))} == {"missing"}
    assert problems(spark, write(tmp_path / "none.csv", [])) == []
    assert column_problems(RAW.read_text_csv(spark, twice), text=True).count() == 1


def test_missing_values_by_their_usual_names(spark, tmp_path, lines):
    fields = [x.split(",") for x in lines]
    at = S.RAW_COLUMNS.index("Partner")
    for f, v in zip(fields, ["NA", "NaN", "null", "None", '""', "N/A"], strict=True):
        f[at] = v
    path = write(tmp_path / "na.csv", [",".join(f) for f in fields])
    assert RAW.read_raw_csv(spark, path, missing=RAW.MISSING).where(F.col("Partner").isNull()).count() == 6
    assert problems(spark, path, missing=RAW.MISSING) == [] and len(problems(spark, path)) == 5  # an empty field alone is missing


def test_duplicates_in_two_phases(spark):
    rows = [(None, "a", 1), ("a", None, 1), (None, "a", 1), ("b", "b", 2), ("b", "b", 2), ("b", "b", 2), ("c", "d", None)]
    df = spark.createDataFrame(rows, "x string, y string, z int")
    assert duplicate_rows(df).first()[0] == 3 and duplicate_rows(df, ["z"]).first()[0] == 4
    assert duplicate_rows(df.limit(0)).first()[0] == 0
    hot = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.lit("x").alias("v"))
    assert duplicate_rows(hot).first()[0] == 2999
    plan = duplicate_rows(hot)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan  # whole rows meet the repeated digests where they are read
