import datetime
import json
import random
import re
import sys
import tracemalloc

import pytest
from pyspark.sql import functions as F

from steerframe.functions import trees as tr
from steerframe.operators import params as po
from steerframe.sources import settings_store as store
from steerframe.streaming import updates as up

TREE = {
    "z": {"attributes": {"label": '{"not": "a tree"}', "value": 0.30}},
    "a": {
        "sub_attr": {
            "b": {"attributes": {"value": True}},
            "attributes": {"attributes": {"value": "s"}},
            "empty": {},
        }
    },
}


def trees(spark, *values):
    rows = [(f"o{i}", v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "owner string, tree string")


def test_flatten_keeps_types(spark):
    rows = po.flatten_params(trees(spark, TREE), "tree", ["owner"]).collect()
    assert {"/".join(r.path): json.loads(r.value) for r in rows} == {
        "z/attributes/label": '{"not": "a tree"}',
        "z/attributes/value": 0.3,
        "a/sub_attr/b/attributes/value": True,
        "a/sub_attr/attributes/attributes/value": "s",
    }


def test_flatten_of_arrays_nulls_and_junk(spark):
    bad = ["no json", "[1, 2]", "", '{"a": 1', '{"a": 1,}', '{"a": 1} x', '{"a": NaN}', "{a: 1}",
           '{"a": {"b": 1}', '{"a" 1}', '{"a": [1}', None]
    df = spark.createDataFrame(
        [("ok", json.dumps({"a": [1, {"b": 2}], "n": None, "e": {}}))] + [("bad", b) for b in bad],
        "owner string, tree string",
    )
    rows = po.flatten_params(df, "tree", ["owner"]).collect()
    good = {r.path[0]: json.loads(r.value) for r in rows if r.error is None}
    assert good == {"a": [1, {"b": 2}], "n": None}
    broken = [r for r in rows if r.error is not None]
    assert all(r.path is None and r.owner == "bad" for r in broken)
    assert sorted(str(r.value) for r in broken) == sorted(map(str, bad))
    assert po.values_only(po.flatten_params(df, "tree", ["owner"])).count() == 0


def random_tree(rng, depth):
    """A text with repeated names, spaces and odd names, and its values with their paths."""
    rows, entries = [], []
    for _ in range(rng.randint(0, 4)):
        name = rng.choice(["a", "b", 'q"', "\u00e9", "", "a"])
        space = rng.choice(["", " ", "\n\t"])
        if depth and rng.random() < 0.6:
            text, below = random_tree(rng, depth - 1)
            rows += [([name, *path], value) for path, value in below]
        else:
            text = rng.choice(["1", "-2.50", "true", "null", '"x{}"', "[1, [2, {}]]", "1e5"])
            rows.append(([name], text))
        entries.append(f"{space}{json.dumps(name)}{space}:{space}{text}{space}")
    return "{" + ",".join(entries) + rng.choice(["", " "]) + "}", rows


def test_flatten_of_random_trees(spark):
    rng, texts, want = random.Random(1), [], []
    for i in range(200):
        text, rows = random_tree(rng, rng.choice([0, 1, 3, 6]))
        texts.append((i, text))
        want += [(i, path, value) for path, value in rows]
    df = spark.createDataFrame(texts, "owner long, tree string").repartition(3)
    got = [(r.owner, r.path, r.value) for r in po.flatten_params(df, "tree", ["owner"]).collect()]
    assert sorted(got) == sorted(want) and len(want) > 300
    nodes = po.tree_nodes(df, "tree", ["owner"]).collect()
    by_owner = {}
    for n in nodes:
        by_owner.setdefault(n.owner, []).append(n)
    for own in by_owner.values():
        assert sorted(n.entry for n in own) == list(range(len(own)))
        for n in own:
            below = [m for m in own if n.entry <= m.entry < n.leave]
            assert all(m.path[: len(n.path)] == n.path for m in below)
            assert n.values == sum(m.value is not None for m in below)


@pytest.mark.parametrize("levels", [2, 7, 200, 3000])
def test_any_depth_round_trips(spark, levels):
    rows = [("o", ["n"] * k, str(k)) for k in (1, levels // 2, levels, levels)] + [
        (None, ["n"] * (levels - 1) + ["m"], "true"), ("o", [], "7"), ("o", None, "8"),
    ]
    df = spark.createDataFrame(rows, "owner string, path array<string>, value string")
    trees = po.unflatten(df, ["owner"])
    # saved trees have the names of saved nodes
    flat = po.values_at(po.flatten_params(trees, "tree", ["owner"]), [po.SAVED_VALUE], po.SAVED_CHILDREN)
    got = sorted(((r.owner or "", r.path, r.value) for r in flat.collect()))
    assert got == sorted((o or "", p, v) for o, p, v in rows if p)


def test_values_only(spark):
    rows = po.values_only(po.flatten_params(trees(spark, TREE), "tree", ["owner"])).collect()
    assert sorted("/".join(r.path) for r in rows) == ["a/attributes", "a/b", "z"]


def test_unflatten_inverts_values_only(spark):
    values = po.values_only(po.flatten_params(trees(spark, TREE), "tree", ["owner"]))
    tree = json.loads(po.unflatten(values, ["owner"]).first().tree)
    assert tree == {
        "z": {"value": 0.3},
        "a": {"sub": {"b": {"value": True}, "attributes": {"value": "s"}}},
    }


def test_node_with_value_and_children(spark):
    rows = spark.createDataFrame(
        [("o", ["a"], "1"), ("o", ["a", 'q"'], "2")],
        "owner string, path array<string>, value string",
    )
    tree = po.unflatten(rows, ["owner"]).first().tree
    assert json.loads(tree) == {"a": {"value": 1, "sub": {'q"': {"value": 2}}}}


def test_lookup_strict(spark):
    values = po.values_only(po.flatten_params(trees(spark, TREE), "tree", ["owner"]))
    requests = spark.createDataFrame(
        [(1, "o0", ["a", "sub_attr", "b"]), (2, "o0", ["a", "b"]), (3, "o0", ["q"])],
        "id long, owner string, path array<string>",
    )
    out = po.lookup(values, requests, ["owner"])
    assert {r.id: r.value for r in out.collect()} == {1: "true", 2: "true", 3: None}
    with pytest.raises(Exception, match="no such path: q"):
        po.lookup(values, requests, ["owner"], strict=True).collect()


def test_upsert_takes_latest(spark):
    schema = "owner string, path array<string>, value string"
    params = spark.createDataFrame([("o", ["a"], "1"), ("o", ["b"], "2")], schema)
    updates = spark.createDataFrame(
        [("o", ["a"], "9", 5), ("o", ["a"], "8", 7), ("o", ["c"], "3", 1)], schema + ", ts int"
    )
    out = po.upsert(params, updates, ["owner"]).collect()
    assert {r.path[0]: r.value for r in out} == {"a": "8", "b": "2", "c": "3"}
    kept = po.reconcile(params, po.upsert(params.limit(0), updates, ["owner"]), ["owner"])
    assert {r.path[0]: r.value for r in kept.collect()} == {"a": "8", "b": "2"}


def test_tags(spark):
    row = spark.createDataFrame([("o", ["a", "b"])], "owner string, path array<string>").select(
        po.tag(F.col("owner"), F.col("path")).alias("t")
    )
    assert row.first().t == "o_-_a_-_b"
    assert row.select(po.split_tag(F.col("t")).alias("s")).first().s == ["o", "a", "b"]


def test_select_sets_default_and_missing(spark):
    requests = spark.createDataFrame(
        [(1, ["y", "x"]), (2, []), (3, None), (4, ["none"])], "id long, chosen array<string>"
    )
    sets = spark.createDataFrame(
        [("x", '{"v":1}'), ("y", '{"v":2}'), ("base", '{"v":0}')], "set_name string, tree string"
    )
    out = po.select_sets(requests, sets, "chosen", "base")
    assert sorted((r.id, r.set_ord, r.set_name, r.tree) for r in out.collect()) == [
        (1, 0, "y", '{"v":2}'), (1, 1, "x", '{"v":1}'), (2, 0, "base", '{"v":0}'),
        (3, 0, "base", '{"v":0}'), (4, 0, "none", "{}"),
    ]


@pytest.mark.parametrize("by_owner", [False, True])
def test_store_round_trip(spark, tmp_path, by_owner):
    params = spark.createDataFrame(
        [("o", ["a", "b"], "true"), ("p", ["c"], '"x"')],
        "owner string, path array<string>, value string",
    )
    store.write_params(params, str(tmp_path), by_owner)
    back = store.read_params(spark, str(tmp_path)).select("owner", "path", "value")
    assert sorted(back.collect()) == sorted(params.collect())


def test_store_without_a_file_is_empty(spark, tmp_path):
    assert store.read_params(spark, str(tmp_path / "none")).count() == 0
    assert store.read_chosen(spark, str(tmp_path / "none")).count() == 0


def test_store_skips_broken_lines(spark, tmp_path):
    folder = tmp_path / "params"
    folder.mkdir()
    (folder / "a.json").write_text('{"owner":"o","path":["a"],"value":"1"}\n{"owner": brok\n')
    assert store.read_params(spark, str(tmp_path)).count() == 1


UPDATE = "owner string, path array<string>, value string, ts timestamp"


def run_updates(spark, base, folder, at, **options):
    stream = spark.readStream.schema(UPDATE).option("maxFilesPerTrigger", 1).parquet(folder)
    query = (
        up.apply_updates(stream, base, f"{at}/settings", **options)
        .option("checkpointLocation", f"{at}/ck")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def shuffled_updates(spark, folder, files, seed=3):
    """Updates of few paths whose times are in no order over the files; returns all of them."""
    rng, rows = random.Random(seed), []
    for i in range(files):
        own = [
            (rng.choice("opq"), [rng.choice("abcd")], str(rng.randint(0, 99)),
             datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randint(0, 50)))
            for _ in range(12)
        ]
        spark.createDataFrame(own, UPDATE).coalesce(1).write.mode("append").parquet(folder)
        rows += own
    return spark.createDataFrame(rows, UPDATE)


def as_dict(df):
    rows = [(r.owner, tuple(r.path), r.value) for r in df.collect()]
    assert len({r[:2] for r in rows}) == len(rows)
    return set(rows)


def test_updates_in_any_order_equal_one_batch(spark, tmp_path):
    base = spark.createDataFrame(
        [("o", ["a"], "base"), ("z", ["b"], "kept")], "owner string, path array<string>, value string"
    )
    folder, seen = str(tmp_path / "in"), []
    first = shuffled_updates(spark, folder, 5)
    options = {"buckets": 3, "compact_after": 2, "on_change": lambda df, e: seen.append((e, df.count()))}
    run_updates(spark, base, folder, tmp_path, **options)
    settings = str(tmp_path / "settings")
    assert as_dict(up.read_settings(spark, settings)) == as_dict(po.upsert(base, first, ["owner"]))
    # a restart goes on from what is stored, times of stored values included
    both = first.union(shuffled_updates(spark, folder, 3, seed=4))
    run_updates(spark, base, folder, tmp_path, **options)
    want = as_dict(po.upsert(base, both, ["owner"]))
    assert as_dict(up.read_settings(spark, settings)) == want
    assert [e for e, _ in seen] == list(range(8)) and seen[-1][1] == len(want)
    one = up.read_settings(spark, settings, owner="p")
    assert as_dict(one) == {r for r in want if r[0] == "p"}
    # folders of old batches are gone
    left = [int(p.name) for kind in ("base", "changes", "compacted")
            for p in (tmp_path / "settings" / kind).glob("*")]
    assert min(left) >= 4 and len(list((tmp_path / "settings" / "manifest").glob("*"))) == 2


def test_one_owner_reads_one_bucket(spark, tmp_path):
    base = spark.createDataFrame(
        [(c, ["a"], c) for c in "abcdefgh"], "owner string, path array<string>, value string"
    )
    shuffled_updates(spark, str(tmp_path / "in"), 1)
    run_updates(spark, base, str(tmp_path / "in"), tmp_path, buckets=4)
    one = up.read_settings(spark, str(tmp_path / "settings"), owner="c")
    scans = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in scans and "PushedFilters: [IsNotNull(owner)" in scans
    assert as_dict(one) == {("c", ("a",), "c")}


def test_a_batch_may_run_again(spark, tmp_path):
    """A batch that fails after it has written starts over with the same result."""
    base = spark.createDataFrame(
        [("o", ["a"], "base")], "owner string, path array<string>, value string"
    )
    folder = str(tmp_path / "in")
    changes = shuffled_updates(spark, folder, 4)
    failed = []

    def fail_once(df, epoch):
        if epoch in (0, 2) and epoch not in failed:
            failed.append(epoch)
            raise RuntimeError("lost")

    for _ in range(3):
        try:
            run_updates(spark, base, folder, tmp_path, compact_after=2, on_change=fail_once)
        except Exception as e:
            assert "lost" in str(e)
    assert failed == [0, 2]
    got = up.read_settings(spark, str(tmp_path / "settings"))
    assert as_dict(got) == as_dict(po.upsert(base, changes, ["owner"]))


def test_subtrees_against_a_walk(spark):
    rng, texts = random.Random(2), []
    for i in range(60):
        text, _ = random_tree(rng, 4)
        texts.append((i, text.replace('"b"', '"sub_attr"')))
    df = spark.createDataFrame(texts, "owner long, tree string")
    flat = po.flatten_params(df, "tree", ["owner"]).collect()
    names = ["a", "sub_attr", 'q"', "\u00e9", ""]
    asked = [(n, rng.randint(0, 61), [rng.choice(names) for _ in range(rng.randint(1, 3))]) for n in range(300)]
    requests = spark.createDataFrame(asked, "id long, owner long, path array<string>")

    def plain(path):
        return [p for p in path if p != "sub_attr"]

    want = []
    for n, owner, path in asked:
        found = []
        if plain(path):
            found = [(n, plain(r.path), r.value) for r in flat
                     if r.owner == owner and plain(r.path)[: len(plain(path))] == plain(path)
                     and len([p for p in r.path if p != "sub_attr"]) >= len(plain(path))]
        want += found or [(n, None, None)]
    for width in (2, 1024):
        out = po.subtree(po.tree_nodes(df, "tree", ["owner"]), requests, ["owner"], width)
        got = [(r.id, r.node, r.value) for r in out.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len([w for w in want if w[1]]) > 100


def test_documents_keep_what_is_broken(spark, tmp_path):
    params = spark.createDataFrame(
        [('o"1', ["a"], "1"), ('o"1', ["a", "b"], '"x"'), (None, ["c"], "2"), ("p", ["d"], "[1]")],
        "owner string, path array<string>, value string",
    ).filter("owner IS NOT NULL")
    chosen = spark.createDataFrame([(5, "late"), (1, "first")], "set_ord int, owner string")
    store.write_documents(params, chosen, str(tmp_path))
    (tmp_path / "more.txt").write_text(
        '{"chips": broken\n\n{"params": {"q": {"e": {"value": 3, "sub": {"f": {"value": 4}}}}}}\n{\n[]\n'
    )
    documents = store.read_documents(spark, str(tmp_path))
    assert as_dict(store.document_params(documents)) == as_dict(params) | {
        ("q", ("e",), "3"), ("q", ("e", "f"), "4")}
    choice = sorted((r.set_ord, r.owner) for r in store.document_choice(documents).collect())
    assert choice == [(0, "first"), (1, "late")]
    broken = {r.value for r in store.broken_documents(documents).collect()}
    assert broken == {'{"chips": broken', "{", "[]"}


def test_redose_takes_all_updates(spark, monkeypatch):
    from steerframe.catalog import params as catalog

    seen, whole = [], catalog.dosing.redose
    monkeypatch.setattr(
        catalog.dosing, "redose",
        lambda trees, tree, changes, *rest: seen.append(changes) or whole(trees, tree, changes, *rest),
    )
    sf = "/root/testdata/sf0.001"
    catalog.redose(spark, sf)
    assert seen[0].count() == catalog.updates(spark, sf).count()


def test_values_of_a_deep_tree_do_not_copy_the_path_of_every_level():
    levels = 3000
    text = '{"n":' * levels + "1" + "}" * levels
    tracemalloc.start()
    rows = tr.leaves(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == [(["n"] * levels, "1", None)]
    # a list of 3000 names is 24 kB; a copy for each level is 36 MB
    assert peak < 3_000_000


@pytest.mark.parametrize(
    "text", ['{"a":01}', '{"a":1.}', '{"a":-}', '{"a":1 2}', '{"a":"\\x"}', '{"a":"b\tc"}',
             '{"a\tb":1}', '{"a":nullx}', '{"a":1,}', '{"a" 1}', '{"a":{"b":1}', '{"a":NaN}'],
)
def test_plain_names_and_values_are_read_no_looser_than_others(text):
    assert tr.leaves(text)[0][0] is None and tr.leaves(text)[0][2]


def test_plain_names_and_values_are_kept_as_written():
    text = '{ "a" : -0.50e+3 ,"b\\n":"x\\"\\u00e9","c":"\\/","d":%s}' % ("1" * 300)
    assert tr.leaves(text) == [
        (["a"], "-0.50e+3", None), (["b\n"], '"x\\"\\u00e9"', None), (["c"], '"\\/"', None),
        (["d"], "1" * 300, None),
    ]


def test_saved_values_are_not_sent_whole_to_every_task(spark):
    """Known and saved values that are made by user code, guessed smaller than they are."""
    values = po.values_only(po.flatten_params(trees(spark, TREE), "tree", ["owner"]))
    out = po.reconcile(values, values, ["owner"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert sorted(map(str, out.collect())) == sorted(map(str, values.collect()))


def read_all(text):
    return tr.leaves(text), tr.members(text)


def test_plain_members_are_read_as_step_by_step(monkeypatch):
    """Whole trees and damaged ones: the same rows and reasons if no member counts as plain."""
    rng, texts = random.Random(5), ["{}", " { } ", "{} x", "", None, '{"a":{"b":1} "c":2}']
    for _ in range(2000):
        text, _ = random_tree(rng, rng.choice([0, 1, 3, 6]))
        texts.append(text)
        at = rng.randrange(len(text))
        texts.append(text[:at] + rng.choice(["", "}", "{", ",", '"', ":", " "]) + text[at + rng.randint(0, 2) :])
    plain = [read_all(text) for text in texts]
    assert 500 < sum(bool(rows) and rows[0][0] is None for rows, _ in plain) < 3500
    monkeypatch.setattr(tr, "_PLAIN_MEMBER", re.compile("(?!)"))
    assert [read_all(text) for text in texts] == plain


def test_a_plain_member_is_read_by_one_match():
    text = "{" + ",".join('"n%d":{"label":"x","value":%d}' % (i, i) for i in range(100)) + "}"
    seen = []
    sys.setprofile(lambda _, event, f: seen.append(f.__name__) if event == "c_call" else None)
    try:
        rows = tr.leaves(text)
    finally:
        sys.setprofile(None)
    assert rows[:2] == [(["n0", "label"], '"x"', None), (["n0", "value"], "0", None)] and len(rows) == 200
    # 300 members, and the ends of the tree
    assert seen.count("match") < 310


def test_trees_are_put_together_by_as_many_tasks_as_the_session_shuffles_to(spark):
    """Rows with paths are shuffled small, which must not leave them to a task for each core."""
    rows = spark.range(200).select(
        F.col("id").alias("owner"), F.array(F.lit("a")).alias("path"), F.lit("1").alias("value")
    )
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        out = po.unflatten(rows, ["owner"])
        assert out.rdd.getNumPartitions() == 24
        assert out.filter("tree = '{\"a\":{\"value\":1}}'").count() == 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_a_bucket_of_settings_is_written_by_several_tasks(spark, tmp_path):
    base = spark.range(400).select(
        F.concat(F.lit("o"), "id").alias("owner"), F.array(F.lit("a")).alias("path"), F.lit("1").alias("value")
    )
    shuffled_updates(spark, str(tmp_path / "in"), 1)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        run_updates(spark, base, str(tmp_path / "in"), tmp_path, buckets=2)
    finally:
        spark.conf.set(key, old)
    folder = tmp_path / "settings" / "base" / "0"
    files = [len(list((folder / f"bucket={i}").glob("*.parquet"))) for i in range(2)]
    assert all(1 < n <= up.WRITERS for n in files)
    assert spark.read.parquet(str(folder)).distinct().count() == 400
