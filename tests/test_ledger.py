"""Files that arrive one after the other are read once each; a file delivered anew replaces its rows."""

from pyspark.sql import functions as F

from latewing.sources import ledger


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def state(spark, out):
    return sorted((r[ledger.SOURCE], r.a, r.asDict().get("b")) for r in ledger.rows(spark, f"{out}/t").collect())


def test_each_file_once(spark, tmp_path):
    inbox, out = tmp_path / "in box+1", tmp_path / "out"
    inbox.mkdir()
    take = lambda: ledger.take_new(spark, str(inbox), f"{out}/t", f"{out}/l")
    assert take() == []
    put(inbox / "2024_04.csv", "a\n1\n2\n")
    assert take() == ["2024_04.csv"] and take() == []
    put(inbox / "sub" / "2024_05.csv", "b,a\nx,3\n")
    put(inbox / "_hidden.csv", "a\n9\n")
    assert take() == ["sub/2024_05.csv"]
    assert state(spark, out) == [("2024_04.csv", "1", None), ("2024_04.csv", "2", None), ("sub/2024_05.csv", "3", "x")]
    put(inbox / "2024_04.csv", "a\n7\n")          # corrected and delivered again
    assert take() == ["2024_04.csv"]
    assert state(spark, out) == [("2024_04.csv", "7", None), ("sub/2024_05.csv", "3", "x")]


def test_a_run_that_stopped_is_made_again(spark, tmp_path):
    """Rows written, ledger not: the next run takes the file again and leaves no copies."""
    inbox, out = tmp_path / "in", tmp_path / "out"
    put(inbox / "m.csv", "a\n1\n2\n")
    ledger.take_new(spark, str(inbox), f"{out}/t", f"{out}/lost")
    assert ledger.take_new(spark, str(inbox), f"{out}/t", f"{out}/l") == ["m.csv"]
    assert ledger.rows(spark, f"{out}/t").agg(F.count(F.lit(1))).first()[0] == 2
