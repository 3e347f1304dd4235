import pytest

from tidewell.plans.dialect import QueryError, Select, Where, parse, plan

GOOD = [
    ("SELECT * FROM users", Select("users")), ("select * from users", Select("users")), ("SELECT * FROM users;", Select("users")),
    ("  SELECT * FROM users  ", Select("users")), ("SELECT * FROM my_table_1", Select("my_table_1")), ("SELECT * FROM users LIMIT 10", Select("users", limit=10)),
    ("SELECT * FROM users WHERE id >= 100", Select("users", Where(">=", 100))), ("SELECT * FROM Users WHERE ID>=-100 LIMIT 5", Select("Users", Where(">=", -100), 5)),
    ("SELECT * FROM t WHERE id != 3;;", Select("t", Where("!=", 3))), ("SELECT\n*\tFROM t", Select("t")),
]
BAD = [
    ("", "empty query"), (" ; ", "empty query"), ("SELECT * FROM users WHERE name = 1", "only WHERE id"), ("SELECT * FROM", "syntax"), ("SELECT a FROM users", "syntax"),
    ("INSERT INTO users VALUES (1)", "syntax"), ("SELECT * FROM t LIMIT 5 WHERE id = 1", "syntax"), ("SELECT * FROM t WHERE id = 9223372036854775808", "invalid WHERE"),
    ("SELECT * FROM t LIMIT 99999999999", "invalid LIMIT"), ("SELECT * FROM 1t", "syntax"), ("SELECT * FROM t WHERE id == 1", "syntax"), ("SELECT * FROM t;;;", "syntax"),
]


@pytest.mark.parametrize("text,want", GOOD)
def test_good(text, want):
    assert parse(text) == want


@pytest.mark.parametrize("text,says", BAD)
def test_bad(text, says):
    with pytest.raises(QueryError, match=says):
        parse(text)


def test_matches():
    s = parse("SELECT * FROM t WHERE id >= 10")
    assert [s.matches(k) for k in (9, 10, 11)] == [False, True, True]
    assert parse("SELECT * FROM t").matches(-1)


def test_plan_pushes_down(spark, tmp_path):
    spark.range(1000).selectExpr("id AS key", "cast(cast(id AS string) AS binary) AS value").write.parquet(str(tmp_path / "t"))
    df = plan(parse("SELECT * FROM t WHERE id >= 990 LIMIT 3"), spark.read.parquet(str(tmp_path / "t")))
    assert [r.id for r in df.collect()] == [990, 991, 992]
    text = df._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key,990)" in text and "TakeOrderedAndProject" in text
    assert plan(parse("SELECT * FROM t LIMIT 0"), spark.read.parquet(str(tmp_path / "t"))).count() == 0
