from tidewell.cli import HELP, answers
from tidewell.sources.store import KVStore


def test_prompt(spark, tmp_path):
    store = KVStore(spark, str(tmp_path / "kv"))
    store.ingest(30)
    lines = ["put 5 hello  big world", "", "GET 5", "set 6 x", "rm 6", "get 6", "scan 5 6", "get", "put 1", "scan 0 99999999", "sql SELECT * FROM nothing_here", "sql DELETE", "help", "stats", "quit", "get 5"]
    out = list(answers(store, lines))
    assert out[:6] == ["ok", "hello big world", "ok", "ok", "not found", "5\thello big world"]
    assert out[6].startswith("error: usage") and out[7].startswith("error: usage") and out[8].endswith("... and 11 more")
    assert out[9] == "nothing" and out[10].startswith("error: syntax") and out[11] == HELP and "read_count" in out[12] and len(out) == 13
