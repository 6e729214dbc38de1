"""Small hand-made cases for operators: graphs, deltas, history, rules, caches, catalog, stream."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from skein.functions import fields, names, paths, secrets
from skein.functions.shared import shared_path
from skein.operators import admission, cache, delta, history, index, merkle, nearest, retrieve, search, stores, traverse
from skein.sources import catalog
from skein.streaming import deltas as stream


def ids(df, *columns):
    return sorted(tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect())


def graph(spark, entities, relations):
    e = spark.createDataFrame(entities, "id string, kind string, name string, file_origin string")
    r = spark.createDataFrame([(i, *x) for i, x in enumerate(relations)], "id int, kind string, src string, dst string")
    return e, r


CHAIN = ([("a", "function", "a", "1"), ("b", "function", "b", "2"), ("c", "function", "c", "3")], [("calls", "a", "b"), ("calls", "b", "c"), ("calls", "c", "ghost")])


def test_neighborhood_stops_at_the_depth(spark):
    e, r = graph(spark, *CHAIN)
    nodes, rel = traverse.neighborhood(e, r, "a", 1)
    assert ids(nodes, "id") == ["a", "b"] and ids(rel, "id") == [0]
    assert ids(traverse.neighborhood(e, r, "nobody", 3)[0], "id") == []
    nodes, rel = traverse.neighborhood(e, r, "a", 5)
    assert ids(nodes, "id") == ["a", "b", "c"] and ids(rel, "id") == [0, 1, 2]


def test_traverse_returns_an_absent_start(spark):
    _, r = graph(spark, *CHAIN)
    assert ids(traverse.traverse(r, "nobody", None, 2), "node") == ["nobody"]
    assert ids(traverse.traverse(r, "ghost", None, 2), "node", "depth") == [("b", 2), ("c", 1), ("ghost", 0)]


def test_impact_excludes_the_start_and_survives_cycles(spark):
    e, r = graph(spark, CHAIN[0], [("calls", "a", "b"), ("calls", "b", "c"), ("calls", "c", "a")])
    assert ids(traverse.downstream_impact(e, r, "c", 9), "id", "depth") == [("a", 2), ("b", 1)]


def test_dead_code(spark):
    e, r = graph(
        spark,
        [("used", "function", "used", "a.rs"), ("own", "function", "own", "a.rs"), ("caller", "function", "caller", "b.rs"), ("t", "function", "t", "tests/x.rs"), ("m", "method", "X.__get__", "a.rs"), ("v", "module", "v", "a.rs"), ("n", "function", "n", None), ("o", "function", "o", None)],
        [("calls", "caller", "used"), ("calls", "used", "own"), ("calls", "n", "o"), ("calls", "ghost", "caller")],
    )
    assert ids(traverse.dead_code(e, r), "id") == ["caller", "n", "o", "own"]


def test_has_incoming_counts_absent_sources(spark):
    e, r = graph(spark, CHAIN[0], [("calls", "ghost", "a"), ("calls", "b", "b")])
    assert ids(traverse.has_incoming(e, r, None, True), "id") == ["a"]
    assert ids(traverse.has_incoming(e, r, ["calls"], False), "id") == ["a", "b"]
    assert ids(traverse.has_incoming(e, r, [], False), "id") == [] == ids(traverse.has_incoming(e, r, [], True), "id")
    tagged = r.withColumn("src_tag", F.when(F.col("src") == "ghost", "Artifact").otherwise("Entity"))
    assert ids(traverse.has_incoming(e, tagged, None, True), "id") == [] and ids(traverse.has_incoming(e, tagged, None, False), "id") == ["a", "b"]


@pytest.mark.parametrize("local", [0, 3, 20_000])
def test_random_graph_against_python(spark, monkeypatch, local):
    monkeypatch.setattr(traverse, "LOCAL_NODES", local)
    rng = random.Random(3)
    edges = [("calls", str(rng.randrange(12)), str(rng.randrange(12))) for _ in range(20)]
    e, r = graph(spark, [(str(i), "function", str(i), str(i)) for i in range(12)], edges)
    want, level = {"0": 0}, {"0"}
    for depth in range(1, 4):
        level = {d for _, s, d in edges if s in level} - set(want)
        want |= dict.fromkeys(level, depth)
    assert dict(ids(traverse.neighborhood(e, r, "0", 3)[0], "id", "depth")) == want


def test_first_parents(spark):
    c = spark.createDataFrame([("r", []), ("a", ["r"]), ("b", ["a", "z"]), ("x", ["y"]), ("y", ["x"])], "id string, parents array<string>")
    assert ids(traverse.first_parent_lineage(c, "b"), "id", "distance") == [("a", 1), ("b", 0), ("r", 2)]
    assert ids(traverse.first_parent_cycles(c), "id") == ["x", "y"]
    assert ids(history.missing_parents(c), "id", "parent") == [("b", "z")]


@pytest.mark.parametrize(("pattern", "want"), [("*user", ["getUser"]), ("get*", ["getPost", "getUser"]), ("html", ["parseTableFromHtml"]), ("extension", ["extension_registry"]), ("xtens", ["ManagerForExtensions", "extension_registry"]), ("*x*", []), ("*", ["ManagerForExtensions", "extension_registry", "getPost", "getUser", "parseTableFromHtml"])])
def test_name_patterns(spark, pattern, want):
    e = spark.createDataFrame([(n, n) for n in ("getUser", "getPost", "parseTableFromHtml", "extension_registry", "ManagerForExtensions")], "id string, name string")
    assert ids(index.by_name_pattern(e, pattern), "name") == want


def test_tokens_agree_with_python(spark):
    words = ["getHTTPServer2", "snake_case/Path.rs", "", "ABC", "aB", "für Ärger_überAll", "naïveÉtude", "日本語Text", "e\u0301te\u0301"]
    assert names.python_tokens("für") == ["für"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(names.tokens(F.col("w"))).collect()
    assert [r[0] for r in got] == [names.python_tokens(w) for w in words]


def test_remove_file_keeps_incoming(spark):
    e, r = graph(spark, *CHAIN)
    kept, rel, gone = index.remove_file(e, r, "2")
    assert ids(gone, "id") == ["b"] and ids(rel, "id") == [0, 2] and ids(kept, "id") == ["a", "c"]


def test_diff_and_apply_round_trip(spark):
    rng = random.Random(5)
    make = lambda: spark.createDataFrame([(i, rng.choice([None, "x", "y"])) for i in rng.sample(range(40), 25)], "id int, v string")
    old, new = make(), make()
    d = delta.diff_map(old, new)
    assert delta.same_rows(delta.apply_map(old, d), new)
    assert delta.diff_map(new, new).isEmpty()
    assert delta.prove({"t": old}, {"t": new}) == "t" and delta.prove({"t": new}, {"t": new}) is None


def test_multisets_keep_repeats(spark):
    old = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    new = spark.createDataFrame([("a",), ("c",), ("c",), (None,)], "v string")
    d = delta.diff_multiset(old, new)
    assert ids(d, "op", "v") == [("added", "c"), ("added", "c"), ("removed", "b")]
    assert delta.apply_multiset(old, d).count() == 5


def test_delta_guards(spark):
    base = spark.createDataFrame([(1, "p"), (2, "q")], "id int, path string")
    d = spark.createDataFrame([("added", 3, "p"), ("added", 3, "r"), ("modified", 9, "s"), ("removed", 8, None)], "op string, id int, path string")
    assert ids(delta.tree_problems(base, d), "problem", "value") == [("id named twice", "3"), ("path held twice", "p")]
    assert ("modified", "9") in ids(delta.reference_problems(base, d), "problem", "id")
    with pytest.raises(ValueError, match="both"):
        delta.merge_absent(base, base)


def test_compact(spark):
    _, r = graph(spark, *CHAIN)
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    hints = spark.createDataFrame([(1, "t1"), (2, "t2")], "hint int, test_id string")
    kept, tables, stats = delta.compact(nodes, r, {"hints": (hints, "test_id", spark.createDataFrame([("t1",)], "test string"))})
    assert ids(kept, "id") == [0, 1] and tables["hints"].count() == 1
    assert dict(ids(stats, "what", "removed")) == {"relations": 1, "outgoing": 1, "incoming": 1, "hints": 1}


def test_search(spark):
    e = spark.createDataFrame([(1, "function", "getUserById", None), (2, "function", "deletePost", " removes a user's post "), (3, "class", "QdpReader", None)], "id int, kind string, name string, doc_summary string")
    post = search.postings(search.with_fields(e, fields.entity_fields(e)))
    n = post.select("id", "length").distinct()
    assert [r.id for r in search.search_postings(post, n, "user", 5).collect()] == [1, 2]
    assert search.search_postings(post, n, "nothing", 5).count() == 0
    assert search.doc_frequency(post, "user post") == 1 and search.doc_frequency(post, "user absent") == 0
    assert [r.id for r in search.search_postings(post, n, "qdp", 10).collect()] == [3] == [r.id for r in search.search_postings(post, n, "eade", 10).collect()]
    assert search.search_postings(post, n, "eade", 10, part=0).count() == 0


def test_active_at(spark):
    d = spark.createDataFrame([("in", 0, None), ("ended", 0, 1), ("later", 2, None)], "id string, introduced int, ended int")
    assert ids(d.where(search.active_at(F.col("introduced"), F.col("ended"), F.lit(1))), "id") == ["in"]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0])], "id int, embedding array<float>")
    assert [tuple(r) for r in nearest.knn(v, [1.0, 0.0], 4).collect()] == [(1, 0.0), (2, 1.0), (4, 1.0), (3, 2.0)]
    assert nearest.knn(v, [1.0, 0.0], 1, F.col("id") > 2).first().id == 4
    with pytest.raises(Exception, match="elements"):
        nearest.upsert_vectors(v, spark.createDataFrame([(9, [1.0])], "id int, embedding array<float>"), 2).collect()
    assert nearest.count_present(v, spark.createDataFrame([(1,), (1,), (7,)], "id int")) == 1
    assert nearest.salvage(v, spark.createDataFrame([(1,)], "id int"))[1] == 3


def test_embedding_pipeline(spark):
    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    texts = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, "known")], "id int, text string")
    stored = texts.where("id = 4").select(F.lit("m").alias("namespace"), nearest.cache_key(F.col("text")).alias("hash"), F.array(F.lit(9.0).cast("float"), F.lit(9.0).cast("float")).alias("embedding"))
    got, new = nearest.embed_all(texts, stored, "m", model, 2)
    assert {r.id: list(r.embedding) for r in got.collect()} == {1: [2.0, 1.0], 2: [1.0, 1.0], 3: [2.0, 1.0], 4: [9.0, 9.0]}
    assert calls.value == 2 and new.count() == 2


def test_packing():
    assert nearest.pack_batches([5, 3, 9], 8) == [[2], [0, 1]]
    assert nearest.pack_batches([100], 8) == [[0]] and nearest.pack_batches([], 8) == []
    assert nearest.split_devices([1, 2, 3, 4], 1.0) == ([0, 1], [2, 3])
    assert nearest.check_response([(1, [1.0]), (0, [0.0])], 2) == [[0.0], [1.0]]
    for bad in ([(2, [])], [(0, []), (0, [])], [(0, [])]):
        with pytest.raises(ValueError):
            nearest.check_response(bad, 2)


def test_sidecar():
    now = dict.fromkeys(nearest.FIELDS, "a")
    assert nearest.classify_sidecar(now, now) == ("exact", None)
    assert nearest.classify_sidecar(now | {"stamp": "b"}, now) == ("stamp_drift", "stamp")
    assert nearest.classify_sidecar(now | {"model": "x", "dims": "y"}, now) == ("refuse", "model")
    assert nearest.classify_sidecar(now | {"stamp": "000"}, now) == ("refuse", "stamp")
    assert nearest.provider({"SKEIN_EMBED_PROVIDER": "OpenAI"}) == "openai" and nearest.provider({"SKEIN_EMBED_PROVIDER": "?"}) == "local"


def test_texts(spark):
    e = spark.createDataFrame([("trait_def", "N", "", " doc ", None)], "kind string, name string, signature string, doc_summary string, file_origin string")
    assert e.select(fields.entity_text(e, F.array(F.lit("x"), F.lit("y")))).first()[0] == "trait\nN\ndoc\nx\ny"
    assert [f.text for f in e.select(fields.entity_fields(e)).first()[0]] == ["N", "doc", "TraitDef"]
    s = spark.createDataFrame([("f", "rust", 2, 1, ["a", "b"], [])], "file_id string, language_hint string, declaration_count int, import_count int, declaration_names array<string>, import_paths array<string>")
    assert s.select(fields.shallow_file_text()).first()[0] == "shallow_file\nfile=f\nlanguage_hint=rust\ndeclaration_count=2\nimport_count=1\ndeclarations=a b"
    assert len(s.select(fields.shallow_file_fields()).first()[0]) == 5


def test_retrieve_with_any_arm_absent(spark):
    e = spark.createDataFrame([(1, "source"), (2, "test")], "id int, role string")
    lex = spark.createDataFrame([(1, 2.0), (3, 1.0)], "id int, score double")
    got = retrieve.unified(e, lexical=lex).collect()
    assert [(r.id, r.lexical_score, r.graph_hops, r.role) for r in got] == [(1, 2.0, None, "source"), (3, 1.0, None, None)]


def test_history_problems(spark):
    d = spark.createDataFrame([("b", 1, "x", "added", None, "1"), ("b", 2, "x", "added", None, "2"), ("b", 3, "y", "removed", "1", None), ("b", 4, "x", "modified", "9", "3"), ("b", 5, "x", "removed", "3", None)], "branch string, seq int, id string, op string, old string, new string")
    assert ids(history.problems(d), "seq", "problem") == [(2, "added but present"), (3, "removed but absent"), (4, "stale old value")]
    back = history.invert(d.where("seq = 5"))
    assert ids(back, "op", "new") == [("added", "3")]
    twice = spark.createDataFrame([("a", "a", "p"), ("a", "a", "p"), ("b", "b", "p"), ("b", "b", "q"), ("c", "d", "p")], "key string, id string, payload string")
    assert ids(history.id_problems(twice), "id") == ["b", "d"]


@pytest.mark.parametrize(
    ("path", "is_dir", "want"),
    [("a.tmp", False, "rule"), ("x/a.tmp", False, "rule"), ("keep.tmp", False, "rule"), ("build", True, "rule"), ("build", False, "default"), ("build/keep.tmp", False, "ignored ancestor"), ("src/x.rs", False, "default"), ("doc/a/b.md", False, "rule"), ("sub/only", False, "rule"), ("only", False, "default"), (".git/x", False, "control")],
)
def test_ignore_rules(spark, path, is_dir, want):
    rules = admission.compile_rules([("root", None, "*.tmp\n!keep.tmp\nbuild/\n# no\n\ndoc/**/*.md"), ("sub", "sub", "/only")])
    r = admission.decide(spark.createDataFrame([(path, is_dir, False)], "path string, is_dir boolean, tracked boolean"), rules).first()
    assert r.reason == want and r.decision == ("admit" if want == "default" or path == "keep.tmp" else "refuse")


def test_thousands_of_rules(spark):
    lines = "\n".join(f"dir{i}/*.tmp\n!dir{i}/keep.tmp" for i in range(1500)) + "\nlast/"
    rules = admission.compile_rules([("root", None, lines)])
    d = spark.createDataFrame([("dir1499/a.tmp", False, False), ("dir7/keep.tmp", False, False), ("last/x", False, False), ("dir7/a", False, False), (None, False, False)], "path string, is_dir boolean, tracked boolean")
    got = {r.path: (r.decision, r.reason, r.line) for r in admission.decide(d, rules).collect()}
    assert got == {"dir1499/a.tmp": ("refuse", "rule", 2999), "dir7/keep.tmp": ("admit", "rule", 16), "last/x": ("refuse", "ignored ancestor", 3001), "dir7/a": ("admit", "default", None), None: ("admit", "default", None)}
    assert admission.decide(d, []).where("decision = 'admit'").count() == 5


def test_rule_sets():
    import hashlib

    s = {"source": "a", "precedence": 0, "base": None, "contents": "x", "content_hash": hashlib.sha256(b"x").hexdigest(), "content_len": 1}
    assert admission.rule_set_problems([s]) == []
    assert len(admission.rule_set_problems([s | {"precedence": 1, "base": "/b", "content_len": 2}])) == 3
    assert admission.policy_hash([s]) != admission.policy_hash([s | {"precedence": 1}])


@pytest.mark.parametrize(("path", "text", "want"), [("a.py", "token = next_token", None), ("a.env", "token = next_token", "credential_assignment"), ("a.py", 'token = "abcdefgh1"', "credential_assignment"), ("a.py", 'token = f("abcdefgh1")', None), ("x.pem", "", "sensitive_path"), ("a.txt", "key ghp_" + "a" * 30, "cloud_credential"), ("a.txt", "MY_API_KEY: changeme-now", None), (".env.sample", "x", None)])
def test_secrets(spark, path, text, want):
    assert spark.createDataFrame([(path, text)], "p string, t string").select(secrets.finding(F.col("p"), F.col("t"))).first()[0] == want


def test_nonproduction(spark):
    want = {"tests/a.rs": True, "src/test.rs": False, "a_test.go": True, "x\\examples\\y.py": True, "conftest.py": True, "latest/a.rs": False}
    got = spark.createDataFrame([(k,) for k in want], "p string").select("p", paths.is_nonproduction(F.col("p"))).collect()
    assert dict(map(tuple, got)) == want


def test_hashes(spark):
    d = spark.createDataFrame([(1.5,), (-0.0,)], "x float")
    assert [bytes(r[0]) for r in d.select(merkle.float_bytes(F.col("x"))).collect()] == [struct.pack("<f", 1.5), struct.pack("<f", -0.0)]
    h = spark.createDataFrame([(f"{i:064x}",) for i in (3, 1, 2)], "hash string")
    assert merkle.fold(h, "d").first() == merkle.fold(h.repartition(3), "d").first()
    e, r = graph(spark, *CHAIN)
    e = e.withColumn("hash", F.sha2(F.col("id").cast("binary"), 256))
    changed = e.withColumn("hash", F.when(F.col("id") == "c", "x").otherwise(F.col("hash")))
    one, two = ({x.id: x.hash for x in merkle.subgraph_hashes(t, r, 1).collect()} for t in (e, changed))
    assert one["a"] == two["a"] and one["b"] != two["b"]
    assert merkle.root([merkle.fold(h, "d")]) != merkle.root([merkle.fold(h.limit(2), "d")])


def test_cache(spark):
    e = spark.createDataFrame([("a", 10, "2024-01-01 00:10:00"), ("a", 10, "2024-01-01 00:50:00"), ("b", 5, "2024-01-01 02:00:00"), ("a", 7, "2024-01-01 03:00:00")], "schema string, bytes long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert ids(cache.eviction_hours(e, 20), "bytes") == [20]
    assert cache.eviction_hours(e, 99).count() == 0
    kept, gone = cache.collect_garbage(e, "a", 100)
    assert kept.count() == 3 and gone.count() == 1
    assert cache.totals(e).first().bytes == 32 and [r.schema for r in cache.by_schema(e, "b").collect()] == ["b", "a"]
    n = spark.createDataFrame([("s", 5, 50)], "stage string, n int, nanos int")
    assert cache.stage_timings(n, n).first().nanos == 0


def test_stores(spark):
    items = spark.createDataFrame([("w", "bug", "open", [("Entity", "e1")]), ("v", "task", "done", [])], "work_id string, kind string, status string, scopes array<struct<tag:string,id:string>>")
    assert ids(stores.in_scope(items, "Entity", "e1"), "work_id") == ["w"] and ids(stores.work_items(items, status="done"), "work_id") == ["v"]
    tests = spark.createDataFrame([("t1",), ("t2",)], "test_id string")
    rel = spark.createDataFrame([("covers", "t1", "e")], "kind string, src string, dst string")
    assert ids(stores.tests_for("e", tests, rel), "test_id") == ["t1"]


def test_catalog(spark, tmp_path):
    c = catalog.GraphCatalog(spark, f"file:{tmp_path}/repo")
    e, r = graph(spark, *CHAIN)
    assert c.head() is None
    assert c.save({"entities": e, "relations": r}) == 1
    with pytest.raises(catalog.Conflict):
        c.save({"entities": e}, expected=0)
    more = e.unionByName(spark.createDataFrame([("d", "class", "d", "4")], e.schema))
    assert c.save_delta(c.compute_delta({"entities": more}), 1) == 2
    assert c.save_delta(c.compute_delta({"entities": more})) is None
    assert ids(c.load(["entities"], {"entities": ["id"]}, verify=True)["entities"], "id") == ["a", "b", "c", "d"]
    assert [d["generation"] for d in c.deltas_since(1)] == [2] and c.deltas_since(2) == []
    assert c.compact() == 3 and ids(c.load()["relations"], "id") == [0, 1] and c.compact() is None
    assert c.clear_deltas() == 4 and c.generations() == [4] and c.unnamed() == [] and c.files.names("quarantine") == []
    assert len(c.files.names("data")) == 2 and c.files.names("tmp") == []
    with pytest.raises(catalog.CatalogError, match="read-only"):
        catalog.GraphCatalog(spark, f"file:{tmp_path}/repo", read_only=True).save({"entities": e})
    assert catalog.list_repos(spark, f"file:{tmp_path}") == ["repo"]
    name = c.put_blob(b"abc")
    assert c.put_blob(b"abc") == name and c.get_blob(name, 3) == b"abc"
    with pytest.raises(catalog.CatalogError, match="larger"):
        c.get_blob(name, 2)
    c.save_overlay("r", "s", e)
    c.save_overlay("r", "s", e.limit(2))
    assert c.load_overlay("r", "s").count() == 2
    c.delete_overlay("r", "s")
    assert c.load_overlay("r", "s") is None


def test_a_write_cut_off_at_any_step(spark, tmp_path):
    """Torn manifests are passed over, replaced, promoted or discarded; torn blobs are mended."""
    root = f"file:{tmp_path}/repo"
    c = catalog.GraphCatalog(spark, root)
    e, _ = graph(spark, *CHAIN)
    c.save({"entities": e})
    at = tmp_path / "repo"
    for torn in (b"", b"{", b'{"version": 1'):
        (at / "manifest-000000000002.json").write_bytes(torn)
        assert c.head()["generation"] == 1 and c.load()["entities"].count() == 3
    assert c.save({"entities": e.limit(1)}) == 2 and c.load()["entities"].count() == 1 and len(c.files.names("torn")) == 1
    # Cut off between folders and manifest, and between the temporary manifest and its name.
    lost = c._write({"entities": e})
    assert c.unnamed() == [lost["entities"]["path"]]
    kept = c._write({"entities": e})
    c.files.stage("manifest-000000000003.json", catalog.sealed(c.head() | {"generation": 3, "snapshot": 3, "tables": kept, "deltas": []}))
    c.files.stage("manifest-000000000004.json", b"{")
    c.files.stage("manifest-000000000009.json", catalog.sealed(c.head() | {"generation": 9}))
    done = c.recover()
    assert "promoted 3" in done and c.load(verify=True)["entities"].count() == 3 and c.unnamed() == [] and c.files.names("tmp") == [] and c.recover() == []
    name = c.put_blob(b"abcdef")
    (at / "blobs" / name).write_bytes(b"abc")
    with pytest.raises(catalog.CatalogError, match="hash"):
        c.get_blob(name, 100)
    assert c.put_blob(b"abcdef") == name and c.get_blob(name, 6) == b"abcdef"
    temp = c.files.stage("x", b"1")
    assert c.files.rename(temp, "y/z") and not c.files.rename(c.files.stage("x", b"2"), "y/z") and c.files.read("y/z") == b"1"


def test_guards_reject_a_delta_as_a_whole(spark, tmp_path):
    c = catalog.GraphCatalog(spark, f"file:{tmp_path}/repo")
    tree, refs = spark.createDataFrame([(1, "p"), (2, "q")], "id int, path string"), spark.createDataFrame([(7, "x")], "id int, name string")
    c.save({"tree": tree, "refs": refs}, kinds={"tree": "tree", "refs": "references"})
    good = {"tree": spark.createDataFrame([("added", 3, "r")], "op string, id int, path string")}
    for bad in ({"tree": spark.createDataFrame([("added", 3, "p")], "op string, id int, path string")}, {"refs": spark.createDataFrame([("added", 7, "y")], "op string, id int, name string")}, {"tree": spark.createDataFrame([("added", 4, "a"), ("removed", 4, None)], "op string, id int, path string")}, {"tree": spark.createDataFrame([("put", 4, "a")], "op string, id int, path string")}):
        with pytest.raises(catalog.Rejected):
            c.save_delta(good | bad)
    with pytest.raises(catalog.Rejected, match="as a whole"):
        c.save_delta(good, validate=lambda t: t["tree"].where("path = 'r'"))
    assert c.head()["generation"] == 1 and len(c.files.names("data")) == 2
    assert c.save_delta(good, validate=lambda t: t["tree"].where("path = 'nothing'")) == 2


def test_locks_and_modes(spark, tmp_path, monkeypatch):
    root = f"file:{tmp_path}/repo"
    e, _ = graph(spark, *CHAIN)
    w = catalog.GraphCatalog.open(spark, root, bootstrap={"entities": e})
    assert w.head()["generation"] == 1
    for mode in ("write", "read"):
        with pytest.raises(catalog.Conflict, match="locked"):
            catalog.GraphCatalog.open(spark, root, mode)
    assert catalog.GraphCatalog.open(spark, root, "locate").load(columns={"entities": ["id"]})["entities"].columns == ["id"]
    w.close()
    one, two = (catalog.GraphCatalog.open(spark, root, "read") for _ in range(2))
    with pytest.raises(catalog.Conflict):
        catalog.GraphCatalog.open(spark, root)
    one.close(), two.close()
    files = catalog.Files(spark, root)
    files.local = False  # lock files, as on file systems without locks
    with catalog.Lock(files):
        with pytest.raises(catalog.Conflict):
            catalog.Lock(files, shared=True).__enter__()
        monkeypatch.setattr(catalog, "LEASE", -1)
        with catalog.Lock(files):
            pass
    monkeypatch.setattr(catalog, "LEASE", 3600)
    with catalog.Lock(files, shared=True), catalog.Lock(files, shared=True), pytest.raises(catalog.Conflict):
        catalog.Lock(files).__enter__()
    assert files.names("locks") == []


def test_quarantine_keeps_what_isn_t_as_recorded(spark, tmp_path):
    c = catalog.GraphCatalog(spark, f"file:{tmp_path}/repo")
    e, _ = graph(spark, *CHAIN)
    c.save({"entities": e})
    entry = c.head()["tables"]["entities"]
    c.save({"entities": e.limit(1)})
    e.limit(2).write.mode("overwrite").parquet(f"file:{tmp_path}/repo/{entry['path']}")
    with pytest.raises(catalog.CatalogError, match="superseded"):
        c.clear_deltas()
    assert len(c.files.names("quarantine")) == 1 and c.load(verify=True)["entities"].count() == 1


def test_tiers(spark, tmp_path):
    c = catalog.GraphCatalog(spark, f"file:{tmp_path}/repo")
    e, r = graph(spark, *CHAIN)
    c.save({"entities": e, "relations": r})
    hot, cold = c.load_tiered(10**12, 1)
    assert hot["entities"].count() == 3 and cold["entities"].count() == 0
    hot, cold = c.load_tiered(10, 2)
    assert ids(hot["entities"], "id") == ["a", "b"] and ids(hot["relations"], "id") == [0] and cold["entities"].count() == 3
    assert c.save_tiered({"entities": hot["entities"].withColumn("name", F.lit("n"))}) == 2
    t = c.load()
    assert ids(t["entities"], "name") == ["c", "n", "n"] and ids(t["relations"], "id") == [0, 1]


def test_frames(spark, tmp_path):
    from skein.sources import frames

    log = frames.FrameLog(spark, f"file:{tmp_path}/log")
    a, b = (spark.createDataFrame(x, "id int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert log.drain({"t": a}, {"t": a}) is None and log.drain({"t": a}, {"t": b}) == 1 and log.drain({"t": b}, {"t": a}) == 2
    assert log.prove({"t": a}, {"t": a}) is None and log.prove({"t": a}, {"t": b}) == "t" and log.prove({"t": b}, {"t": a}, since=1) is None
    f = log.frames()[0]
    assert frames.decode(frames.encode({k: v for k, v in f.items() if k != "format"})) == f
    with pytest.raises(catalog.CatalogError, match="format"):
        frames.decode(catalog.sealed(f | {"format": 1}))
    with pytest.raises(catalog.CatalogError, match="fields"):
        frames.decode(catalog.sealed(f | {"more": 1}))
    (tmp_path / "log" / "frames" / "frame-000000000001.json").write_bytes(frames.encode(f | {"sequence": 1, "keys": {"t": "id"}}))
    with pytest.raises(catalog.CatalogError, match="follow"):
        log.frames()


def test_sidecars(spark, tmp_path):
    from skein.sources import sidecars

    store = sidecars.Sidecars(spark, f"file:{tmp_path}/s")
    e = spark.createDataFrame([(1, "function", "getUser"), (2, "class", "QdpReader"), (3, "function", "dropUser")], "id bigint, kind string, name string")
    of = lambda d: search.with_fields(d, fields.entity_fields(d))
    t = sidecars.TextIndex(store, "bigint")
    assert t.live_document_count() == 0 and sidecars.TextIndex.peek_stamp(store) is None
    t.upsert(of(e))
    assert t.search("user").count() == 0  # nothing is seen before the commit
    t.commit("r1")
    assert ids(t.search("user"), "id") == [1, 3] and ids(t.search("qdp"), "id") == [2] and t.doc_frequency("user") == 2
    t.upsert(of(e.where("id = 1").withColumn("name", F.lit("other"))))
    t.upsert(of(e.where("id = 1").withColumn("name", F.lit("again"))))
    t.remove(e.where("id = 3"))
    t.commit("r2")
    t = sidecars.TextIndex(store, "bigint")
    assert ids(t.search("user"), "id") == [] and ids(t.search("again"), "id") == [1] and t.search("other").count() == 0
    assert t.live_document_count() == 2 and sidecars.TextIndex.peek_stamp(store) == "r2"
    assert dict(ids(t.contains(e), "id", "contained")) == {1: True, 2: True, 3: False}
    (tmp_path / "s" / "sidecars" / "text-000000000003.json").write_bytes(b"{")
    assert sidecars.TextIndex.peek_stamp(store) == "r2"
    t.rebuild(of(e.where("id = 3")))
    assert sidecars.TextIndex(store, "bigint").live_document_count() == 2

    now = dict.fromkeys(nearest.FIELDS, "a") | {"dims": 2}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id bigint, embedding array<float>")
    assert sidecars.VectorIndex.load_compatible(store, now)[1] == "absent"
    i = sidecars.VectorIndex(store, now, v)
    token = i.key_set_token()
    assert i.get(2) == [0.0, 1.0] and i.get(9) is None and i.contains(1) and len(i) == 2 and i.dimensions == 2
    i.remove(v.where("id = 1"))
    i.upsert(v.where("id = 1").unionByName(v.where("id = 2").withColumn("embedding", F.reverse("embedding"))))
    assert i.key_set_token() == token and i.get(2) == [1.0, 0.0]
    i.save()
    assert sidecars.VectorIndex.load_compatible(store, now)[1:] == ("exact", None) and sidecars.VectorIndex.load_compatible(store, now | {"model": "b"})[1:] == ("refuse", "model")
    drifted, what, _ = sidecars.VectorIndex.load_compatible(store, now | {"stamp": "b"}, v.where("id = 2"))
    assert what == "stamp_drift" and len(drifted) == 1

    calls = spark.sparkContext.accumulator(0)

    def model(ts):
        calls.add(len(ts))
        return [[float(len(x)), 1.0] for x in ts]

    texts = spark.createDataFrame([(k, "x" * k) for k in range(1, 40)], "id int, text string")
    sidecars.embed_with_checkpoints(store, texts.limit(20), "m", model, 2, parts=4)
    first = calls.value
    assert sidecars.embed_with_checkpoints(store, texts.limit(20), "m", model, 2, parts=4).count() == 20 and calls.value == first


def test_inverted_lists_reach_their_recall(spark):
    sf = "/root/testdata/sf0.1"
    v = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    queries = v.where("id % 100 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("q"))
    exact = {(r.query, r.id) for r in nearest.knn_many(v, queries, 10, block=7).collect()}
    one = {r.id for r in nearest.knn(v, list(v.where("id = 100").first().embedding), 10).collect()}
    assert {i for q, i in exact if q == 100} == one
    centres = nearest.fit_lists(v)
    indexed = nearest.with_list(v.select("id", "embedding"), centres)
    assert indexed.count() == v.count() and {(r.query, r.id) for r in nearest.ann_search(indexed, centres, queries, 10, len(centres)).collect()} == exact
    from skein.plans.data_queries import PROBES

    found = {(r.query, r.id) for r in nearest.ann_search(indexed, centres, queries, 10, PROBES).collect()}
    assert len(found & exact) >= 0.9 * len(exact)


def test_many_lineages_at_once(spark):
    c = spark.createDataFrame([("r", []), ("a", ["r"]), ("b", ["a", "z"]), ("s", [])], "id string, parents array<string>")
    got = traverse.first_parent_lineages(c, spark.createDataFrame([("b",), ("a",), ("none",)], "id string"))
    assert ids(got, "target", "change", "distance") == [("a", "a", 0), ("a", "r", 1), ("b", "a", 1), ("b", "b", 0), ("b", "r", 2)]
    with pytest.raises(ValueError, match="cycle"):
        traverse.first_parent_lineages(spark.createDataFrame([("x", ["y"]), ("y", ["x"])], c.schema), spark.createDataFrame([("x",)], "id string"))


def test_small_guards(spark):
    d = spark.createDataFrame([(i, i * 1000) for i in (1, 2, 2, 5, 4)], "k int, o int").withColumn("o", F.monotonically_increasing_id() * 60_000)
    assert ids(delta.require_sorted_unique(d.coalesce(1), "k", "o"), "k") == [2, 4]
    t = spark.createDataFrame([(1,)], "id int")
    assert delta.total_changes({"entities": t, "outgoing": t}) == 1


def test_catalog_finds_damage(spark, tmp_path):
    c = catalog.GraphCatalog(spark, f"file:{tmp_path}/repo")
    e, _ = graph(spark, *CHAIN)
    c.save({"entities": e})
    path = tmp_path / "repo" / c.head()["tables"]["entities"]["path"]
    e.limit(1).write.mode("overwrite").parquet(f"file:{path}")
    with pytest.raises(catalog.CatalogError, match="digest"):
        c.load(verify=True)
    manifest = tmp_path / "repo" / "manifest-000000000001.json"
    manifest.write_text(manifest.read_text().replace('"version": 1', '"version": 2'))
    (tmp_path / "repo" / ".manifest-000000000001.json.crc").unlink(missing_ok=True)
    with pytest.raises(catalog.CatalogError, match="checksum"):
        c.head()


def test_stream_folds_its_deltas(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    log = shared_path(spark) + "/log"
    for g, row in enumerate([("added", 3, "c"), ("modified", 1, "x"), ("removed", 3, None), ("added", 3, "again"), ("removed", 2, None)], 1):
        spark.createDataFrame([(g, *row)], "generation long, op string, id int, v string").coalesce(1).write.mode("append").parquet(log)
    for fold in (1, 2, 99):
        state, last = stream.follow(spark, log, spark.read.parquet(log).schema, base, per_batch=1, fold=fold)
        assert last == 5 and ids(state, "id", "v") == [(1, "x"), (3, "again")] and state.columns == base.columns


def test_stream_refuses_gaps(spark):
    log = shared_path(spark) + "/log"
    base = spark.createDataFrame([(1, "a")], "id int, v string")
    spark.createDataFrame([(1, "added", 2, "b"), (3, "removed", 1, None)], "generation long, op string, id int, v string").write.parquet(log)
    with pytest.raises(Exception, match="generation 3 after 1"):
        stream.follow(spark, log, spark.read.parquet(log).schema, base)


def test_refresh_equals_a_full_pass(spark):
    rng = random.Random(8)
    e, r = graph(spark, [(str(i), "function", str(i), str(i)) for i in range(60)], [("calls", str(rng.randrange(60)), str(rng.randrange(60))) for _ in range(50)])
    e = e.select("id", F.sha2(F.col("id").cast("binary"), 256).alias("hash"))
    changed = e.withColumn("hash", F.when(F.col("id").isin("3", "4"), "new").otherwise(F.col("hash")))
    got = merkle.refresh(merkle.subgraph_hashes(e, r, 2), changed, r, e.where("id in ('3', '4')"), 2)
    assert ids(got, "id", "hash") == ids(merkle.subgraph_hashes(changed, r, 2), "id", "hash")
    assert merkle.graph_root(got) != merkle.graph_root(merkle.subgraph_hashes(e, r, 2)) and merkle.graph_root(got.limit(0))


def test_versioned_roots(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    one = merkle.versioned_root(5, {"t": d, "outgoing": d.limit(0)})
    assert one == merkle.versioned_root(5, {"t": d.orderBy(F.desc("id")), "outgoing": d}) != merkle.versioned_root(5, {"t": d.union(d)})
    labels = d.select("id", F.lit(1).alias("component"))
    assert merkle.component_hashes(d.select("id", F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("hash")), d, labels).count() == 1


def test_shared_folder_and_small(spark):
    from skein.functions import shared

    class Cluster:
        conf = {}

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = dict

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_path(Cluster)
    d = spark.createDataFrame([("x" * 100, [(1, "abc")], {"k": "v"})] * 3, "s string, a array<struct<n:int,t:string>>, m map<string,string>")
    assert shared.is_small(d) and not shared.is_small(d, rows=2) and not shared.is_small(d, most=300)


def test_spread_join(spark, monkeypatch):
    from skein.functions import shared

    rng = random.Random(2)
    rows = spark.createDataFrame([(rng.choice([1, 1, 1, 2, 3, None]), i) for i in range(300)], "k int, v int")
    look = spark.createDataFrame([(1, "a"), (2, "b"), (9, "c")], "k int, w string")
    for how in ("inner", "left"):
        want = ids(rows.join(look, "k", how), "k", "v", "w") if how == "inner" else sorted(map(str, rows.join(look, "k", how).collect()))
        monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
        got = shared.spread_join(rows, look, ["k"], ["v"], how, hot=20)
        assert (ids(got, "k", "v", "w") if how == "inner" else sorted(map(str, got.select("k", "v", "w").collect()))) == want
        monkeypatch.setattr(shared, "BROADCAST_ROWS", 400_000)
