import os
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from graphloom.sources import datasource, vault


def some_nodes(nodes_of, n=40):
    return nodes_of([{
        "id": f"pkg{i % 3}/node{i}", "type": "module" if i % 2 else "function", "namespace": "" if i % 4 == 0 else "ns", "status": "superseded" if i % 5 == 0 else "active",
        "edges": [(f"pkg{(i + 1) % 3}/node{i + 1}", "calls")], "tags": ["a", "b"], "summary": f"About é {i}", "context": "line\n---\nline", "source": (f"src/{i}.py", [1, i + 1], f"h{i}"),
    } for i in range(n)])


def plain(df):
    return sorted((r.id, r.type, r.namespace, r.status, tuple(r.source), tuple(map(tuple, r.edges)), tuple(r.tags), r.summary, r.context) for r in df.collect())


def files_below(root):
    return sorted(str(p.relative_to(root)) for p in Path(root).rglob("*") if p.is_file())


def test_round_trip_by_tasks(spark, nodes_of, tmp_path):
    nodes, root = some_nodes(nodes_of), tmp_path / "vault"
    datasource.write(nodes.repartition(5), str(root))
    assert files_below(root) == sorted(f"pkg{i % 3}/node{i}.md" for i in range(40)) and not (root / "_staging").exists()
    got = datasource.read(spark, str(root), files_per_partition=7)
    assert plain(got) == plain(nodes) and got.rdd.getNumPartitions() == 6
    assert plain(vault.read_vault(spark, f"file://{root}")) == plain(nodes)  # the reader of any vault agrees
    (root / "bad.md").write_text("no frontmatter")
    (root / "_heat").mkdir()
    (root / "_heat" / "x.md").write_text("---\nid: x\n---\n")
    (root / "free.md").write_text("---\nid: other\n---\nA summary.\n")
    assert datasource.read(spark, f"file://{root}", vault_id="v1").where("id LIKE 'o%'").select("id", "vault_id").collect() == [("other", "v1")]
    assert datasource.read(spark, str(root)).count() == 41
    assert datasource.read(spark, str(tmp_path / "none")).count() == 0


def test_filters_reach_the_files(spark, nodes_of, tmp_path):
    nodes, root = some_nodes(nodes_of), str(tmp_path / "vault")
    datasource.write(nodes, root)
    read = lambda **o: datasource.read(spark, root, **o)
    for rule in ("status = 'active'", "namespace = 'ns' AND status IN ('active', 'archived')", "id = 'pkg1/node1'", "id IN ('pkg1/node1', 'pkg2/node2', 'none')", "status = 'active' AND summary LIKE '%1%'", "namespace = ''"):
        for layout in ("ids", "free"):
            assert plain(read(layout=layout).where(rule)) == plain(nodes.where(rule)), (rule, layout)
    plan = read().where("status = 'active' AND summary <> ''")._jdf.queryExecution().executedPlan().toString()
    assert "status" not in plan.split("Filter")[1].split("\n")[0] and "summary" in plan.split("Filter")[1].split("\n")[0]  # only this one is left to Spark
    one = datasource.VaultReader({"path": root, "layout": "ids"})
    assert not list(one.pushFilters([datasource.EqualTo(("id",), "pkg1/node1")])) and one.partitions() == [datasource.Files(("pkg1/node1.md",))]
    left = datasource.VaultReader({"path": root})
    kept = [datasource.EqualTo(("source", "path"), "x"), datasource.EqualTo(("summary",), "x")]
    assert list(left.pushFilters(kept)) == kept
    assert datasource.VaultReader({"path": root, "layout": "ids"}).partitions()[0].paths != ()


def test_a_failed_job_leaves_nothing(spark, nodes_of, tmp_path):
    root = tmp_path / "vault"
    datasource.write(some_nodes(nodes_of, 6), str(root))
    before = {f: (root / f).read_text() for f in files_below(root)}

    @F.udf("string")
    def break_late(i):
        if i.endswith("node30"):
            raise RuntimeError("killed")
        return "new text"

    broken = some_nodes(nodes_of).coalesce(2).withColumn("summary", break_late("id"))
    with pytest.raises(PySparkException):
        datasource.write(broken, str(root))
    assert {f: (root / f).read_text() for f in files_below(root)} == before and not (root / "_staging").exists()


def test_a_task_that_ran_twice_counts_once(spark, nodes_of, tmp_path):
    """A task is killed after it wrote; the second attempt's files are committed, the first one's go."""
    root, rows = str(tmp_path / "vault"), some_nodes(nodes_of, 4).collect()
    writer = datasource.VaultWriter({"path": root}, [], False)
    writer.write(iter(rows[:3]))  # its message is lost with the task
    second = writer.write(iter(rows[:2]))
    assert files_below(root) and all(f.startswith("_staging") for f in files_below(root))
    writer.commit([second, None, writer.write(iter([]))])
    assert files_below(root) == ["pkg0/node0.md", "pkg1/node1.md"]


def test_append_replaces_and_overwrite_removes(spark, nodes_of, tmp_path):
    root = str(tmp_path / "vault")
    datasource.write(some_nodes(nodes_of, 6), root)
    datasource.write(nodes_of([{"id": "pkg0/node0", "summary": "new"}, {"id": "../bad"}, {"id": "added"}]), root)
    got = {r.id: r.summary for r in datasource.read(spark, root).collect()}
    assert len(got) == 7 and got["pkg0/node0"] == "new" and got["pkg1/node1"] == "About é 1"
    datasource.write(nodes_of([{"id": "only"}]), root, "overwrite")
    assert files_below(root) == ["only.md"]


def test_a_stream_of_changed_nodes(spark, nodes_of, tmp_path):
    root, out, check = tmp_path / "vault", str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        q = datasource.changes(spark, str(root)).select("id", "summary").writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out)
        q.awaitTermination(120)
        return sorted((r.id, r.summary) for r in spark.read.parquet(out).collect())

    datasource.write(nodes_of([{"id": "a"}, {"id": "b/c"}]), str(root))
    assert run() == [("a", "about a"), ("b/c", "about b/c")]
    assert len(run()) == 2  # nothing new after a restart from the checkpoint
    (root / "a.md").write_text("---\nid: a\n---\nChanged.\n")
    (root / "d.md").write_text("---\nid: d\n---\nNew.\n")
    (root / "_config.md").write_text("---\nversion: 1\n---\n")
    os.remove(root / "b" / "c.md")
    assert run() == [("a", "Changed."), ("a", "about a"), ("b/c", "about b/c"), ("d", "New.")]
