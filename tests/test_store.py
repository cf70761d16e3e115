"""The log, snapshots, cleaning, and what lookups read."""

import json
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lorequarry.config import Config, Embedding, Storage
from lorequarry.engine import KnowledgeBase
from lorequarry.errors import KnowledgeError
from lorequarry.operators import graph
from lorequarry.store import Store, shared_folder


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def base(spark, tmp_path):
    return KnowledgeBase(spark, Config(storage=Storage(path=str(tmp_path / "kb")), embedding=Embedding(onnx_path="mock", dimension=8)))


def test_entries_stay_small_and_any_state_can_be_made_from_them(spark, base):
    for i in range(24):
        base.store.commit({"meta": base.store.meta_table(**{f"k{i}": i})})
    log = {p.name: p.stat().st_size for p in Path(base.store.path, "log").glob("*.json")}
    sizes = [n for name, n in log.items() if ".full" not in name]
    assert len(sizes) == 25 and max(sizes) - min(sizes) < 30 and sorted(n for n in log if ".full" in n) == ["000000000010.full.json", "000000000020.full.json"]
    states = {v: base.store.pointer(v) for v in (1, 9, 10, 11, 25)}
    assert {v: len(s["tables"]["meta"]) for v, s in states.items()} == {1: 1, 9: 9, 10: 10, 11: 11, 25: 25}
    for name in log:
        if ".full" in name:
            Path(base.store.path, "log", name).unlink()
    assert {v: base.store.pointer(v) for v in states} == states
    with pytest.raises(KnowledgeError):
        base.store.pointer(99)


def test_snapshots_show_what_was_and_cannot_be_written(spark, base):
    told = base.upload(content=["one alpha", "two alpha"]).collect()
    before = base.store.pointer()["version"]
    base.delete(told[0].document_id)
    base.upload(content="three alpha beta")
    then = base.as_of(before)
    assert {r.content for r in then.table("document").collect()} == {"one alpha", "two alpha"}
    assert {r.content for r in then.search("alpha", mode="keyword").collect()} == {"one alpha", "two alpha"}
    assert {r.content for r in base.search("alpha", mode="keyword").collect()} == {"two alpha", "three alpha beta"}
    with pytest.raises(KnowledgeError):
        then.upload(content="no")
    with pytest.raises(KnowledgeError):
        base.as_of(99)


def test_cleaning_removes_what_no_kept_state_names(base):


    base.upload(content=["one alpha", "two beta"])
    base.upload(content="three gamma")
    old = base.store.pointer()["version"]
    base.compact()
    parts = lambda: {str(p.relative_to(base.store.path)) for p in Path(base.store.path).glob("tables/*/v=*/u=*")}
    assert base.clean(3600) == 0 and base.as_of(old).stats()["document_count"] == 3
    time.sleep(1.1)
    assert base.clean(0) > 5
    named = {p for ps in base.store.pointer()["tables"].values() for p in ps}
    assert parts() == named and not list(Path(base.store.path).glob("uploads/*"))
    assert base.stats()["document_count"] == 3 and base.search("gamma", mode="keyword").count() == 1


def test_a_log_of_whole_states_is_read_and_gone_on_with(spark, base):
    base.upload(content="one alpha")
    state = base.store.pointer()
    path = f"{base.store.path}/log/{state['version']:012d}.json"
    with open(path, "w") as f:
        json.dump({k: state[k] for k in ("version", "schema", "tables", "deleted", "forgotten", "stats")}, f)
    base.upload(content="two alpha")
    assert base.stats()["document_count"] == 2 and base.search("alpha", mode="keyword").count() == 2


def test_uploads_look_content_up_by_prefix(spark, base):
    base.upload(content=[f"text number {i}" for i in range(60)])
    hashes = spark.createDataFrame([("text number 7",), ("unknown",)], "t string").select(F.sha2("t", 256).alias("sha256"))
    known = base.store.known(hashes, base.store.pointer())
    assert known.count() == 1
    shown = plan(known)
    assert "PartitionFilters: [prefix" in shown and "ReadSchema: struct<sha256:string>" in shown
    assert [r.status for r in base.upload(content=["text number 7", "fresh"]).collect()] == ["skipped", "created"]


def test_a_hop_reads_the_folders_of_its_nodes(spark, base):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "r", 1.0) for i in range(300)], "src string, dst string, relation string, weight double")
    base.store.commit({"related_to": edges})
    stored = base.store.edges(base.store.pointer())
    front = spark.createDataFrame([("n5",)], "node string")
    shown = plan(graph.leaving(stored, front, "node"))
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", shown)
    starts = spark.createDataFrame([("a", "n0", 0)], "start string, node string, depth int")
    found = graph.bfs(starts, stored, 4)
    assert sorted((r.node, r.depth) for r in found.collect()) == [(f"n{i}", i) for i in range(5)]
    assert base.table("related_to").columns == ["src", "dst", "relation", "weight"] and base.table("related_to").count() == 300


def test_a_shared_folder_must_be_named_on_a_cluster(spark):
    class Conf:
        def get(self, key):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(KnowledgeError):
        shared_folder(Session())
    assert shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert Store(spark, "/nowhere/at/all").pointer()["version"] == 0
