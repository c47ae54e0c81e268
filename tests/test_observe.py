import json

import pytest

from locusforge import api
from locusforge.functions.observe import Observer
from locusforge.sources import scratch
from tests import fixtures as fx


def test_phases_of_a_store_are_told_and_kept(spark, tmp_path):
    heard, log = [], tmp_path / "log" / "events.jsonl"
    watch = Observer(callback=heard.append, jsonl=str(log))
    made = api.compress(spark, fx.study(spark, 30).drop("z"), scratch.new_path(spark, "seen"), observer=watch)
    names = ["quality_control", "select_and_number", "encode_and_write"]
    assert [(p["phase"], p["status"], p["rows"]) for p in watch.phases] == [(n, "done", 30) for n in names]
    assert [(e["event"], e["phase"]) for e in heard] == [(k, n) for n in names for k in ("start", "end")]
    assert [json.loads(x)["phase"] for x in log.read_text().splitlines()] == [e["phase"] for e in heard]
    assert set(made.manifest["timings"]) == {f"{n}_s" for n in names} | {"write_s"}
    assert watch.table(spark).where("status = 'done' and rows = 30").count() == 3
    assert made.manifest["source"]["columns"][:2] == ["ordinal", "chromosome"] and made.manifest["tasks"] >= 1


def test_failures_of_phases_and_of_those_who_watch():
    watch = Observer(callback=lambda e: 1 / 0)
    with pytest.raises(KeyError), watch.phase("a"):
        raise KeyError("x")
    assert watch.phases[0]["status"] == "failed" and watch.failures == 2
    quiet = Observer("off", callback=lambda e: 1 / 0)
    with quiet.phase("a"):
        pass
    assert not quiet.phases and not quiet.failures
    with pytest.raises(ValueError, match="level"):
        Observer("loud")
