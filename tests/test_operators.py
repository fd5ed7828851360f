"""Relational operators against brute force, published values and recovered parameters."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphweave import queries
from glyphweave.kernels import fuzz, pairwise
from glyphweave.operators import blocking, evaluate, model, review, search
from glyphweave.operators.components import connected_components
from glyphweave.operators.prefix import with_running
from glyphweave.plans.link import Compare, conjuncts, rlink
from glyphweave.sources import append_decisions
from glyphweave.streaming import stream_block, stream_pairs


def pairs_of(df):
    return sorted((r["x_id"], r["y_id"], r["pass"]) for r in df.collect())


def test_block_pairs(spark):
    people = spark.createDataFrame([(1, "SMITH", "1"), (2, "SMYTH", "2"), (3, "JONES", "3"), (4, "SMITH", "4"), (5, "JONES", "5"), (6, None, "2")], "id int, surname string, dob string")
    found = pairs_of(blocking.block_pairs(people, ["surname", "dob"], "id"))
    assert found == [(1, 4, 1), (2, 6, 2), (3, 5, 1)]
    x, y = (spark.createDataFrame(list(enumerate(k, 1)), "id int, k string") for k in (["4000", "4101", None], ["4101", "4000", "4000"]))
    assert pairs_of(blocking.block_pairs(x, ["k"], "id", y, ["k"], "id")) == [(1, 2, 1), (1, 3, 1), (2, 1, 1)]
    assert blocking.block_pairs(x, ["k"], "id", y, ["k"], "id", max_block_size=2).count() == 1
    assert blocking.block_pairs(x.limit(0), ["k"], "id").count() == 0


def test_passes_carry_values_and_find_each_pair_once(spark):
    """Against all pairs, with nulls in keys, a hot key and a limit of block sizes."""
    draw = random.Random(6)
    rows = [(i, draw.choice([1, 1, 1, 2, 3, None]), draw.choice("abcdef"), draw.randrange(9)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, k int, l string, m int")
    for most in (None, 20):
        sizes = [{v: sum(r[c] == v for r in rows) for v in {r[c] for r in rows}} for c in (1, 2, 3)]
        usable = lambda c, v: v is not None and (most is None or sizes[c - 1][v] <= most)  # noqa: E731, B023
        wanted = {}
        for x in rows:
            for y in rows:
                first = [c for c in (1, 2, 3) if x[c] == y[c] and usable(c, x[c])]
                if x[0] < y[0] and first:
                    wanted[x[0], y[0]] = (first[0], x[3], y[2])
        found = blocking.block_pairs(df, ["k", "l", "m"], "id", max_block_size=most, carry={"left": F.col("m")}, carry_y={"right": F.col("l")}).collect()
        assert len(found) == len(wanted) and {(r["x_id"], r["y_id"]): (r["pass"], r["left"], r["right"]) for r in found} == wanted


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_over_ranges(spark, descending):
    draw = random.Random(9)
    rows = [(k, draw.randrange(100)) for k in draw.sample(range(10_000), 900)]
    df = spark.createDataFrame(rows, "k int, v int")
    for in_range in (10, 10_000):
        found = {r["k"]: r["total"] for r in with_running(df, "k", {"total": "v"}, descending, in_range).collect()}
        total, wanted = 0, {}
        for k, v in sorted(rows, reverse=descending):
            total += v
            wanted[k] = total
        assert found == wanted
    assert with_running(df.limit(0), "k", {"total": "v"}).count() == 0


def test_components_of_hubs_and_chains(spark):
    edges = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(500, 620)] + [(700, 700), (None, 3), (800, 801), (801, 800)]
    found = {r["node"]: r["component"] for r in connected_components(spark, spark.createDataFrame(edges, "a int, b int")).collect()}
    assert found == {**{k: 0 for k in range(400)}, **{k: 500 for k in range(500, 621)}, 800: 800, 801: 800}


def test_streams_are_blocked(spark, tmp_path):
    rows = [[(1, "a", "2026-01-01 00:00:00"), (2, "b", "2026-01-01 00:01:00"), (3, None, "2026-01-01 00:01:00")], [(7, "a", "2026-01-01 00:02:00"), (8, "a", "2026-01-01 09:00:00"), (9, "b", "2026-01-01 00:01:30")]]
    sides = []
    for k, own in enumerate(rows):
        spark.createDataFrame(own, "id int, key string, at string").select("id", "key", F.to_timestamp("at").alias("at")).write.parquet(f"{tmp_path}/{k}")
        sides.append(spark.readStream.schema("id int, key string, at timestamp").parquet(f"{tmp_path}/{k}"))
    table = spark.createDataFrame([("a", 10), ("c", 11)], "key string, n int")
    jobs = {"paired": stream_pairs(sides[0], "key", "id", "at", sides[1], "key", "id", "at", "10 minutes"), "blocked": stream_block(sides[0], ["key"], table, ["key"]).select("id", "n")}
    for name, df in jobs.items():
        job = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/at-{name}").trigger(availableNow=True).start()
        assert job.awaitTermination(120)
    assert sorted((r["x_id"], r["y_id"]) for r in spark.table("paired").collect()) == [(1, 7), (2, 9)]
    assert [tuple(r) for r in spark.table("blocked").collect()] == [(1, 10)]


def test_log_is_written_whole(spark, tmp_path):
    path = f"file://{tmp_path}/log.json"
    assert append_decisions(spark, path, runs=[{"run_id": "r", "reviewer": "a"}], decisions=[{"pair_id": "p", "reviewer": "a", "run_id": "r", "decision": "include"}]) == {"runs": 1, "thresholds": 0, "decisions": 1}
    before = (tmp_path / "log.json").read_text()
    more = [{"event_id": "e", "pair_id": "p", "reviewer": "b", "run_id": "r", "decision": "exclude", "comment": "ä"}]
    assert append_decisions(spark, path, decisions=more)["decisions"] == 1 and append_decisions(spark, path, decisions=more)["decisions"] == 0
    log = json.loads((tmp_path / "log.json").read_text())
    assert [e["seq"] for e in log["decisions"]] == [0, 1] and log["decisions"][1]["comment"] == "ä" and log["created"] == json.loads(before)["created"]
    assert json.loads((tmp_path / "log.json.bak").read_text())["decisions"] == log["decisions"]
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith(".")) == ["log.json", "log.json.bak"]
    held = review.read_decisions(spark, path)
    assert [r["pair_id"] for r in held.disagreements.collect()] == ["p"]
    with pytest.raises(ValueError):
        append_decisions(spark, path, decisions=[{"pair_id": "p", "decision": "maybe"}])


def test_sorted_neighbourhood(spark):
    numbers = spark.createDataFrame(list(enumerate([0, 1, 5, 6, 30], 1)), "id int, k int")
    assert [p[:2] for p in pairs_of(blocking.sorted_neighbourhood(numbers, ["k"], "id", window=3))] == [(1, 2), (2, 3), (3, 4), (4, 5)]
    assert blocking.sorted_neighbourhood(numbers, ["k"], "id", window=1).count() == 0
    with pytest.raises(ValueError):
        blocking.sorted_neighbourhood(numbers, ["k"], "id", window=2)


def test_cluster_pairs(spark):
    links = spark.createDataFrame([(1, 2), (2, 4), (5, 6)], "x_id int, y_id int")
    found = blocking.cluster_pairs(links, records=spark.range(1, 7).withColumn("id", F.col("id").cast("int")), id_col="id")
    assert [r["cluster"] for r in found.orderBy("id").collect()] == [1, 1, 2, 1, 3, 3]


@pytest.mark.parametrize(("weights", "n", "m", "wanted"), [((12, 9, 8), 1, 1, "TFT"), ((1, 9, 8), 1, 1, "FTF"), ((12, 9, 8), 2, 1, "TTF"), ((12, 9, 8), 1, 2, "TFT")])
def test_greedy_values(spark, weights, n, m, wanted):
    df = spark.createDataFrame([(k, i, j, float(w)) for k, ((i, j), w) in enumerate(zip([(1, 1), (1, 2), (2, 2)], weights, strict=True))], "o int, i int, j int, w double")
    assert "".join("T" if r["selected"] else "F" for r in model.select_greedy(df, "i", "j", "w", "o", n, m).orderBy("o").collect()) == wanted


def test_greedy_against_a_loop(spark):
    draw = random.Random(3)
    rows = [(k, draw.randrange(12), draw.randrange(12), float(draw.randrange(6))) for k in range(90)]
    used_i, used_j, wanted = {}, {}, set()
    for k, i, j, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
        if used_i.get(i, 0) < 2 and used_j.get(j, 0) < 1:
            used_i[i], used_j[j] = used_i.get(i, 0) + 1, 1
            wanted.add(k)
    found = model.select_greedy(spark.createDataFrame(rows, "o int, i int, j int, w double"), "i", "j", "w", "o", 2, 1)
    assert {r["o"] for r in found.where("selected").collect()} == wanted


def test_em_recovers_its_parameters(spark):
    rng = np.random.default_rng(42)
    m, u, sizes = np.array([0.95, 0.88, 0.97, 0.98]), np.array([0.02, 0.04, 0.005, 0.5]), (300, 3000)
    level = np.concatenate([rng.random((n, 4)) < p for n, p in zip(sizes, (m, u), strict=True)]).astype(int)
    df = spark.createDataFrame([tuple(map(int, r)) for r in level], "a int, b int, c int, d int")
    fit = model.em_linkage(model.agreement_patterns(df, list("abcd")), list("abcd"))
    assert fit.converged and abs(fit.share - 300 / 3300) < 0.03
    assert all(abs(fit.m[f][1] - p) < 0.1 and abs(fit.u[f][1] - q) < 0.2 for f, p, q in zip("abcd", m, u, strict=True))


def test_value_frequency(spark):
    df = spark.createDataFrame([(1, "SMITH"), (2, "SMITH"), (3, "SMITH"), (4, "NGUYEN"), (5, "ZELINSKY"), (6, None), (7, "")], "id int, v string")
    assert [r["frequency"] for r in model.value_frequency(df, "v").orderBy("id").collect()] == [0.6, 0.6, 0.6, 0.2, 0.2, None, None]


@pytest.mark.parametrize("lower", [False, True])
def test_sweep_against_counting(spark, lower):
    draw = random.Random(11)
    rows = sorted({(draw.randrange(9), draw.randrange(9)) for _ in range(60)})
    rows = [(i, j, draw.randrange(8) / 10) for i, j in rows]
    df = spark.createDataFrame(rows, "x_id int, y_id int, score double")
    truth = df.where("x_id = y_id").select("x_id", "y_id")
    for thresholds in (None, [0.15, 0.4, 0.65]):
        for r in evaluate.threshold_sweep(df, "score", thresholds=thresholds, truth=truth, lower=lower).collect():
            kept = [p for p in rows if (p[2] <= r["threshold"] if lower else p[2] >= r["threshold"])]
            left, right = [p[0] for p in kept], [p[1] for p in kept]
            assert r["n_pairs"] == len(kept) and r["n_linked_1"] == len(set(left)) and r["n_linked_2"] == len(set(right))
            assert r["n_one_to_one"] == sum(left.count(i) == 1 and right.count(j) == 1 for i, j, _ in kept)
            assert r["n_conflict_1"] == sum(left.count(i) > 1 for i in set(left)) and r["tp"] == sum(i == j for i, j, _ in kept)


def test_fuzzy_within_against_all_pairs(spark):
    draw = random.Random(2)
    texts = ["".join(draw.choice("abc") for _ in range(draw.randrange(0, 10))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    found = {(r["query_id"], r["table_id"]): r["distance"] for r in search.fuzzy_within(df, df, "id", "t", "id", "t", max_distance=2, method="levenshtein").collect()}
    every = df.select(F.col("id").alias("a"), F.col("t").alias("s")).crossJoin(df.select(F.col("id").alias("b"), F.col("t").alias("u"))).select("a", "b", F.levenshtein("s", "u").alias("d")).where("d <= 2")
    assert found == {(r["a"], r["b"]): r["d"] for r in every.collect()}


def test_minhash_recall(spark):
    draw = random.Random(4)
    base = ["".join(draw.choice("abcdefghij") for _ in range(60)) for _ in range(30)]
    rows = list(enumerate(base + [b[:-3] + "zzz" for b in base] + base[:3]))
    found = {(r["x_id"], r["y_id"]) for r in search.minhash_pairs(spark.createDataFrame(rows, "id int, t string"), "id", "t", threshold=0.5).collect()}
    assert {(i, i + 30) for i in range(30)} <= found and {(i, i + 60) for i in range(3)} <= found
    assert search.banding(0.5) == (25, 5) and search.banding(0.8) == (9, 13)


def test_rlink_stages_and_exclusion(spark):
    draw = random.Random(8)
    rows = [(i, draw.choice(["SMITH", "SMYTH", "JONES"]), draw.choice(["ann", "anne", None]), draw.randrange(3)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, surname string, given string, region int")
    compare = [Compare("surname"), Compare("given", "levenshtein")]
    whole = rlink(df, "id", ["region"], compare=compare)
    part = rlink(df, "id", ["region"], compare=compare, filter="surname_jaro_winkler >= 0.8 and given_levenshtein > 0.5", keep=["given"], pair_id=True, exclude=spark.createDataFrame([(1, 0)], "x_id int, y_id int"))
    wanted = {(r["x_id"], r["y_id"]) for r in whole.df.where("surname_jaro_winkler >= 0.8 and given_levenshtein > 0.5").collect()} - {(0, 1)}
    assert {(r["x_id"], r["y_id"]) for r in part.df.collect()} == wanted
    assert part.df.columns == ["x_id", "y_id", "pass", "surname_jaro_winkler", "given_levenshtein", "given_1", "given_2", "pair_id"]
    assert conjuncts("a > 1 and (b and c) and d between 1 and 2") == ["a > 1", "(b and c)", "d between 1 and 2"]
    with pytest.raises(ValueError):
        rlink(df, "id", ["region"], max_pairs=3)


def test_decisions(spark, tmp_path):
    event = lambda e, seq, who, pair, said: {"event_id": e, "seq": seq, "run_id": "r", "reviewer": who, "at": f"2026-01-0{seq}", "pair_id": pair, "decision": said}
    log = {
        "schema": "x/decisions", "format_version": 1, "runs": [], "thresholds": [{"event_id": "t", "seq": 0, "run_id": "r", "reviewer": "a", "at": "2026-01-01", "status": "accepted", "rule": "all", "expr": "score > 0.5 & other < 3", "cuts": []}],
        "decisions": [event("1", 1, "a", "p", "include"), event("2", 2, "b", "p", "exclude"), event("3", 3, "a", "q", "exclude")],
    }
    (tmp_path / "log.json").write_text(json.dumps(log))
    held = review.read_decisions(spark, f"file://{tmp_path}/log.json")
    df = spark.createDataFrame([("p", 0.1, 1), ("q", 0.9, 1), ("r", 0.9, 1), ("s", 0.9, 5)], "pair_id string, score double, other int")
    told = lambda rule: [(r["link"], r["link_reason"]) for r in review.apply_decisions(df, held, rule=rule).orderBy("pair_id").collect()]
    assert told("last") == [(False, "decision"), (False, "decision"), (True, "threshold"), (False, "threshold")]
    assert told("unanimous")[0] == (False, "disputed")
    assert [r["pair_id"] for r in held.disagreements.collect()] == ["p"]
    for bad in ("__import__('os')", "score.real > 1", "unknown > 1", "system(score)"):
        with pytest.raises((ValueError, SyntaxError)):
            review.rule_sql(bad, ["score"])


def test_model_queries_take_all_pairs_of_a_brand(spark, tmp_path):
    rng = random.Random(4)
    parts = [(i, f"Brand#{i % 3}", rng.randrange(1, 12), rng.choice("abc"), rng.choice(["tin bolt", "tin bolts", "steel nut", "copper washer"])) for i in range(1, 61)]
    spark.createDataFrame(parts, "p_partkey bigint, p_brand string, p_size int, p_type string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    wanted = sorted((x[0], y[0]) for x in parts for y in parts if x[0] < y[0] and x[1] == y[1])
    for found in (queries.levels(spark, str(tmp_path)), queries.QUERIES["model_rlink_weights"](spark, str(tmp_path))):
        assert sorted((r["x_id"], r["y_id"]) for r in found.collect()) == wanted
    at = {p[0]: p for p in parts}
    for r in queries.levels(spark, str(tmp_path)).collect():
        x, y = at[r["x_id"]], at[r["y_id"]]
        apart = abs(x[2] - y[2])
        assert (r["size_level"], r["type_level"]) == (2 if apart == 0 else 1 if apart <= 5 else 0, int(x[3] == y[3]))
        assert r["name_level"] == (None if x[0] % 50 == 0 else 2 if x[4] == y[4] else 1 if {x[4], y[4]} == {"tin bolt", "tin bolts"} else 0)
    fit = {(r["field"], r["level"]): r for r in queries.QUERIES["model_em_linkage"](spark, str(tmp_path)).collect()}
    assert len(fit) == 8 and all(abs(sum(r[k] for (f, _), r in fit.items() if f == name) - 1) < 1e-5 for name in queries.FIELDS for k in "mu")


@pytest.mark.parametrize("chunk", [4, 1024])
def test_names_are_scored_once_a_class(spark, tmp_path, monkeypatch, chunk):
    """Copies of names make pairs, but not pairs to score; classes and keys over a chunk are dealt to several rows."""
    monkeypatch.setattr(blocking, "CHUNK", chunk)
    names = ["tin bolt", "tin bolts", "steel nut", None]
    parts = [(i, "Brand#1" if i < 70 else "Brand#2", 7, names[i % 4 if i % 3 else 0]) for i in range(90)]
    spark.createDataFrame(parts, "p_partkey bigint, p_brand string, p_size int, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    at = {p[0]: p for p in parts}
    wanted = sorted((x[0], y[0]) for x in parts for y in parts if x[0] < y[0] and x[1] == y[1])
    for name, score in (("fuzz_ratio", fuzz.ratio), ("sim_damerau_levenshtein", lambda a, b: pairwise.damerau(a, b, True)), ("fuzz_partial_ratio_alignment", lambda a, b: fuzz.alignment(a, b)[0])):
        found = queries.QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted((r["x_id"], r["y_id"]) for r in found) == wanted
        for r in found:
            a, b = at[r["x_id"]][3], at[r["y_id"]][3]
            assert r[2] == (None if a is None or b is None else pytest.approx(score(a, b)))
    steps = queries.QUERIES["sim_edit_ops"](spark, str(tmp_path)).collect()
    assert sorted((r["id"], r["step"], r["type"]) for r in steps) == sorted((f"{x}|{y}", k, s["type"]) for x, y in wanted if at[x][3] and at[y][3] for k, s in enumerate(pairwise.edit_ops(at[x][3], at[y][3], False, False), 1))
    rows = queries.name_classes(spark, str(tmp_path)).select(F.size("x_ids").alias("x"), F.size("y_ids").alias("y")).collect()
    assert len(rows) == 32 if chunk > 90 else max(r["x"] for r in rows) < 40


def test_levels_are_counted_without_their_pairs(spark, tmp_path):
    """Copies of parts make pairs, but no more rows of classes; counts of levels agree with those of all pairs."""
    rng = random.Random(5)
    parts = [(i, "Brand#1", rng.randrange(1, 4) * 3, rng.choice("ab"), rng.choice(["tin bolt", "tin bolts", "nut"])) for i in range(50)]
    parts += [(p[0] + 50 * k, *p[1:]) for p in parts for k in (1, 2, 3)]
    spark.createDataFrame(parts, "p_partkey bigint, p_brand string, p_size int, p_type string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    told = {tuple(r)[:3]: r["n"] for r in model.agreement_patterns(queries.level_counts(spark, str(tmp_path)), queries.FIELDS, "n").collect()}
    assert told == {tuple(r)[:3]: r["n"] for r in model.agreement_patterns(queries.levels(spark, str(tmp_path)), queries.FIELDS).collect()} and sum(told.values()) == 199 * 100
    assert queries.level_classes(spark, str(tmp_path)).count() == len({(p[2:], p[0] % 50 == 0) for p in parts}) ** 2
    pairs = [("tin bolt", "bolt tin"), ("", "a"), ("o'neil", "oneil x")]
    calls, kernel = [], pairwise.jaro_winkler
    pairwise.jaro_winkler = lambda *a: calls.append(a) or kernel(*a)
    try:
        found = pairwise.jaro_winkler_tokens(*map(list, zip(*pairs, strict=True)), 0.1, False, pairwise._STRIP, None, False)
    finally:
        pairwise.jaro_winkler = kernel
    assert len(calls) == 1 and found[:2] == [1.0, 0.0]


def test_links_are_rounded_as_in_sql_and_spanned(spark, tmp_path):
    draw = random.Random(7)
    rows = [(1, 1, 1000.0), (2, 1, 1292.5), (3, 2, 1000.0), (4, 2, 1637.5)] + [(k, 3, float(draw.choice([100, 1500, 2900, 9000, 9500, 20000]))) for k in range(5, 40)]
    spark.createDataFrame(rows, "s_suppkey bigint, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, "Brand#1", 1, "ab"), (2, "Brand#1", 1, None)], "p_partkey bigint, p_brand string, p_size int, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    score = {(r["x_id"], r["y_id"]): r["score"] for r in queries.links(spark, str(tmp_path)).collect()}
    assert (score[1, 2], score[3, 4]) == (0.81, 0.57)
    assert [r["value"] for r in queries.QUERIES["sim_hamming"](spark, str(tmp_path)).collect()] == [float("inf")]
    of = lambda df: {r["node"]: r["component"] for r in connected_components(spark, df.select("x_id", "y_id")).collect()}
    few = blocking.spanning(queries.link_classes(spark, str(tmp_path)))
    assert of(few) == of(queries.links(spark, str(tmp_path))) and few.count() < len(score) / 2


def test_pairs_are_handed_on_row_by_row(spark):
    """No generated loop explodes within another: it would hold all pairs of two packs before the first leaves it."""
    classes = spark.createDataFrame([([1, 2, None], [1, 3], 1)], "x_ids array<bigint>, y_ids array<bigint>, pass int")
    for within, wanted in ((True, [(1, 3), (2, 3)]), (False, [(1, 1), (1, 3), (2, 1), (2, 3), (None, 1), (None, 3)])):
        found = blocking.expand(classes, within)
        assert sorted(((r["x_id"], r["y_id"]) for r in found.collect()), key=str) == sorted(wanted, key=str)
        loops = re.findall(r"\*\((\d+)\) Generate", found._jdf.queryExecution().executedPlan().toString())
        assert len(loops) == len(set(loops)) == 1


def test_links_are_judged_without_their_pairs(spark, tmp_path, monkeypatch):
    """Counts by class agree with those of all pairs, and no pair is made for them."""
    draw = random.Random(8)
    rows = [(k, k % 2, float(draw.choice([100, 700, 1500, 2225, 2900, 20000]))) for k in range(70)] + [(70, None, 1.0), (71, 1, None)]
    spark.createDataFrame(rows, "s_suppkey bigint, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    at = str(tmp_path)
    found, true = queries.links(spark, at).where("score >= 0.5"), queries.links(spark, at).where("(x_id + y_id) % 3 <> 0")
    wanted = evaluate.linkage_eval(found, true).first(), evaluate.blocking_eval(found, true, len(rows)).first()
    assert wanted[0]["tp"] == len({tuple(r)[:2] for r in found.collect()} & {tuple(r)[:2] for r in true.collect()}) > 0
    monkeypatch.setattr(blocking, "expand", None)
    assert (queries.QUERIES["eval_linkage"](spark, at).first(), queries.QUERIES["eval_blocking"](spark, at).first()) == wanted


def test_greedy_orders_few_pairs_a_task(spark, monkeypatch):
    """Pairs are written, read and shuffled in parts of about ROWS, so a task's memory does not grow with them."""
    draw, seen, write = random.Random(9), [], model.Work.write
    rows = [(k, draw.randrange(30), draw.randrange(30), float(draw.randrange(9))) for k in range(300)]
    df = spark.createDataFrame(rows, "o int, i int, j int, w double")
    wanted = {r["o"] for r in model.select_greedy(df, "i", "j", "w", "o").where("selected").collect()}

    def watched(work, frame, name):
        out = write(work, frame, name)
        seen.append((int(spark.conf.get("spark.sql.shuffle.partitions")), out.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]))
        return out

    monkeypatch.setattr(model.Work, "write", watched)
    monkeypatch.setattr(model, "ROWS", 16, raising=False)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert {r["o"] for r in model.select_greedy(df, "i", "j", "w", "o").where("selected").collect()} == wanted
    assert all(n is None or n <= 16 for _, n in seen) and seen[1][0] == -(-300 // 16) and spark.conf.get("spark.sql.shuffle.partitions") == before
