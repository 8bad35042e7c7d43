"""Operators on small graphs worked out by hand, and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from graphfold.functions import sequences as sf
from graphfold.operators import cluster, components, context, evaluate, graph, match, merge, partition, simjoin, store


def rows(df, *columns):
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())


@pytest.mark.parametrize("shared", [False, True])
def test_greedy_is_the_sequential_walk(spark, shared):
    rng = random.Random(5)
    pairs = list({(rng.randrange(12), rng.randrange(12, 24) if not shared else rng.randrange(12)): rng.randrange(5) for _ in range(60)}.items())
    pairs = [(a, b, s) for (a, b), s in pairs if a != b]
    found = match.greedy_matching(spark.createDataFrame(pairs, "a long, b long, s long"), "a", "b", F.struct(-F.col("s"), "a", "b"), shared=shared)
    left, right, wanted = set(), set(), []
    if shared:
        right = left
    for a, b, s in sorted(pairs, key=lambda x: (-x[2], x[0], x[1])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            wanted.append((a, b, s))
    assert rows(found, "a", "b", "s") == sorted(wanted)


def test_best_hit_drops_losers_that_greedy_keeps(spark):
    hits = spark.createDataFrame([("q1", "t1", 100), ("q2", "t1", 99), ("q2", "t2", 98)], "q string, t string, s int")
    order = [F.desc("s"), F.asc("q"), F.asc("t")]
    assert rows(match.best_hits(hits, "q", "t", order), "q", "t") == [("q1", "t1")]
    assert rows(match.greedy_matching(hits, "q", "t", F.struct(-F.col("s"), "q", "t")), "q", "t") == [("q1", "t1"), ("q2", "t2")]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)]
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = components.components(spark.createDataFrame(links, "a long, b long"))
    assert rows(found) == sorted((x, find(x)) for x in root)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_context_needs_a_pair_and_not_a_shared_neighbour(spark):
    edges = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z"), ("d", "z")], "u string, v string")
    identities = spark.createDataFrame([("a", "b", 0.8), ("x", "y", 0.95), ("c", "d", 0.8)], "x string, y string, ident double")
    pairs = identities.where("x in ('a', 'c')").selectExpr("x as a", "y as b", "ident")
    found = context.context_ladder(pairs, edges, identities)
    assert rows(found, "a", "b", "s1", "s2", "s3") == [("a", "b", 0.95, 0.95, 0.95), ("c", "d", 0.0, 0.8, 0.8)]


def node_frame(spark, names):
    return spark.createDataFrame([(n, f"about {n}") for n in names], "node_id string, annotation string")


def small_graph(spark, prefix, names, pairs, member):
    nodes = [prefix + n for n in names]
    return merge.Graph(node_frame(spark, nodes), spark.createDataFrame([(n, member) for n in nodes], "node_id string, member string"), spark.createDataFrame([(prefix + a, prefix + b, member) for a, b in pairs], "u string, v string, member string"))


HITS = "query string, target string, ident double, len_sim double, evalue double"


def test_two_equal_graphs_become_one(spark):
    base, new = (small_graph(spark, p, "xyz", [("x", "y"), ("y", "z")], p) for p in ("a", "b"))
    exact = spark.createDataFrame([(f"b{n}", f"a{n}", 1.0, 1.0, 0.0) for n in "xyz"], HITS)
    out = merge.merge_step(base, new, exact, spark.createDataFrame([], HITS))
    assert rows(out.nodes) == [(f"a{n}", f"about a{n}") for n in "xyz"]
    assert rows(out.edges) == sorted((*e, m) for e in (("ax", "ay"), ("ay", "az")) for m in "ab")


def test_no_hits_keep_all(spark):
    base, new = (small_graph(spark, p, "xy", [("x", "y")], p) for p in ("a", "b"))
    out = merge.merge_step(base, new, spark.createDataFrame([], HITS), spark.createDataFrame([], HITS))
    assert out.nodes.count() == 4 and out.edges.count() == 2


def test_context_merges_a_family_pair(spark):
    base, new = (small_graph(spark, p, "xyz", [("x", "y"), ("y", "z")], p) for p in ("a", "b"))
    exact = spark.createDataFrame([("bx", "ax", 1.0, 1.0, 0.0)], HITS)
    family = spark.createDataFrame([("by", "ay", 0.8, 0.9, 0.0), ("bz", "az", 0.95, 0.9, 0.0)], HITS)
    out = merge.fold([base, new], lambda b, n: (exact, family))
    assert sorted(r[0] for r in out.nodes.select("node_id").collect()) == ["ax", "ay", "az"]
    assert out.members.count() == 6


def test_members_in_common_forbid_a_merge(spark):
    pairs = spark.createDataFrame([("p", "q"), ("p", "r")], "a string, b string")
    members = spark.createDataFrame([("p", 1), ("q", 1), ("r", 2)], "node_id string, member int")
    assert rows(match.disjoint(pairs, members, "a", "b")) == [("p", "r")]


def test_contraction_loops(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2)], "u string, v string, member int")
    mapping = spark.createDataFrame([("b", "a")], "old string, new string")
    assert rows(graph.contract(edges, mapping)) == [("a", "c", 2)]
    assert rows(graph.contract(edges, mapping, keep_self_loops=True)) == [("a", "a", 1), ("a", "c", 2)]


def test_deletion_bridges_for_each_member(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("a", "b", 2), ("b", "d", 2)], "u string, v string, member int")
    assert rows(graph.delete_nodes(edges, spark.createDataFrame([("b",)], "node string"))) == [("a", "c", 1), ("a", "d", 2)]
    assert rows(graph.remove_members(edges, spark.createDataFrame([("b", 1)], "node string, member int"))) == [("a", "b", 2), ("a", "c", 1), ("b", "d", 2)]


def test_coalescing_upsert(spark):
    kind = "k int, size int, note string, flag int, last int"
    base = spark.createDataFrame([(1, 5, "old", 1, 1), (2, 6, None, 0, 1)], kind)
    delta = spark.createDataFrame([(1, None, "new", 0, 2), (3, 7, "  ", 0, 2), (4, None, " ", 0, 2)], kind)
    delta = store.with_payload(store.placeholders_to_null(delta, ["note"]), ["size", "note"])
    out = store.coalesce_upsert(base, delta, ["k"], ("last",), ("flag",))
    assert rows(out) == [(1, 5, "new", 1, 2), (2, 6, None, 0, 1), (3, 7, None, 0, 2)]
    again = store.coalesce_upsert(out, delta, ["k"], ("last",), ("flag",))
    assert rows(again) == rows(out)
    with pytest.raises(ValueError, match="twice"):
        store.strict_insert(base, delta.where("k = 1"), ["k"])


def test_store_steps_and_lookups(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "store"))
    members = spark.createDataFrame([("n1", "m1"), ("n2", "m1")], "node_id string, member string")
    lengths = spark.createDataFrame([("n1", 10, 2)], "node_id string, length int, count int")
    for _ in range(2):
        kept.apply({"node_members": members, "node_lengths": lengths})
    assert rows(kept.table("node_members")) == [("n1", "m1"), ("n2", "m1")]
    assert rows(kept.table("node_lengths")) == [("n1", 10, 4)]
    assert rows(kept.nodes_with(member="m1")) == [("n1",), ("n2",)]
    assert kept.table("edges").count() == 0


def test_scores_of_equal_clusterings(spark):
    a = spark.createDataFrame([(i, i % 3) for i in range(30)], "item int, cluster int")
    table = evaluate.contingency(a, a)
    assert evaluate.rand_scores(table).first() == (1.0, 1.0)
    assert evaluate.information_scores(table).first()[1] == pytest.approx(1.0)


def test_balance_and_batches(spark):
    samples = spark.createDataFrame([(f"s{i:03}", c) for i, c in enumerate("a" * 3 + "b" * 4 + "c" * 10 + "d" * 15)], "sample string, cluster string")
    sizes = {r["part"]: r["n"] for r in partition.balance(samples, 5, 12).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"merged": 7, "c": 10, "da": 8, "db": 7}
    batches = rows(partition.fixed_batches(samples, ["sample"], 10).groupBy("batch").count())
    assert batches == [("0000", 10), ("0001", 10), ("0002", 10), ("0003", 2)]


def test_greedy_clusters_are_the_walk(spark):
    rng = random.Random(3)
    items = [(f"i{i:02}", rng.randrange(5)) for i in range(40)]
    pairs = [(a, b) for a, _ in items for b, _ in items if a < b and rng.random() < 0.08]
    near = {(a, b) for a, b in pairs} | {(b, a) for a, b in pairs}
    representatives, wanted = [], []
    for i, _ in sorted(items, key=lambda x: (-x[1], x[0])):
        r = next((r for r in representatives if (i, r) in near), None)
        if r is None:
            representatives.append(i)
        wanted.append((i, r or i))
    found = cluster.greedy_clusters(spark.createDataFrame(items, "id string, length int"), spark.createDataFrame(pairs, "a string, b string"))
    assert rows(found, "id", "representative") == sorted(wanted)


def test_split_keeps_members_apart(spark):
    clusters = spark.createDataFrame([("c", "n1", 1), ("c", "n2", 2), ("c", "n3", 3)], "cluster string, node string, ord int")
    members = spark.createDataFrame([("n1", 1), ("n2", 1), ("n3", 2)], "node string, member int")
    assert rows(cluster.split_by_member(clusters, members, ["ord"])) == [("c", "n1", 0), ("c", "n2", 1), ("c", "n3", 0)]


def test_sequences(spark):
    df = spark.createDataFrame([("ATGGCNTAAGG", "MA*K**", "'007'_1_2")], "dna string, protein string, sid string")
    got = df.select(sf.translate(F.col("dna")), sf.reverse_complement(F.col("dna")), sf.mask_stops(F.col("protein")), sf.normalise_sequence_id(F.col("sid"), 1)).first()
    assert tuple(got) == ("MX*", "CCTTANGCCAT", "MAJK", "8_1_2")


def infix_by_table(query, target):
    table = [[0] * (len(target) + 1)]
    for i, x in enumerate(query, 1):
        table.append([i])
        for j, y in enumerate(target, 1):
            table[i].append(min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (x != y)))
    return min(table[-1])


def test_infix_distance():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("ACG") for _ in range(rng.randrange(1, 12))) for _ in range(2))
        assert sf.infix_distance(a, b, {}) == infix_by_table(a, b)
    assert sf.infix_distance("ANT", "GGACTGG", sf.WILDCARDS_DNA) == 0


def test_similarity_join(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh") for _ in range(80)) for _ in range(10)]
    texts = [(f"s{i}{j}", t[:40] + "x" * j + t[40:]) for i, t in enumerate(base) for j in range(3)] + [("none", "")]
    found = simjoin.similar(spark.createDataFrame(texts, "id string, seq string"), k=8, least_shared=4)
    assert rows(found, "query", "target") == sorted((f"s{i}{a}", f"s{i}{b}") for i in range(10) for a in range(3) for b in range(a + 1, 3))


def edits_by_table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def test_complete_similarity_join(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (1, 2, 7, 10, 20, 25, 40, 60, 90)]
    spread = ["".join("z" if i % 5 == 4 else x for i, x in enumerate(t)) for t in base]
    texts = [(f"s{i:02}", t) for i, t in enumerate([*base, *base, *spread, *(t[: len(t) * 3 // 4] for t in base), "", ""])] + [("t", None)]
    given = [(i, t) for i, t in texts if t is not None]
    wanted = sorted((a, b) for a, s in given for b, t in given if a < b and 1 - edits_by_table(s, t) / max(len(s), len(t), 1) >= 0.7 - 1e-9)
    frame = spark.createDataFrame(texts, "id string, seq string")
    assert rows(simjoin.complete(frame), "query", "target") == wanted
    assert rows(simjoin.complete(frame, frame).where("query < target"), "query", "target") == wanted


@pytest.mark.parametrize("infix", [False, True])
def test_blocks_score_each_pair_of_sequences_once(spark, monkeypatch, infix):
    """Against all pairs by plain Python: repeated rows, an item of two blocks, nulls; the number of distances doesn't grow with copies."""
    names = ["abcd", "bcda", "abcdx", "XXab", "zzzz", ""]
    items = [(f"k{i % 3}", i, names[i * 7 % 6]) for i in range(60)] + [("k0", 1, names[1]), ("k1", 1, names[1]), ("k1", 0, names[0]), (None, 90, "abcd"), ("k0", 91, None)]
    wanted = set()
    for k, a, x in items:
        for k2, b, y in items:
            if k is not None and k == k2 and a < b and x is not None and y is not None:
                s, t = (x, y) if len(x) <= len(y) else (y, x)
                edits = sf.infix_distance(s, t, sf.WILDCARDS_PROTEIN) if s and infix else 0
                ident = (0.0 if edits > 0.5 * len(s) else 1 - edits / max(1, len(s))) if infix else 1 - edits_by_table(x, y) / max(len(x), len(y), 1)
                if ident >= 0.5:
                    wanted.add((a, b, round(ident, 6)))
    held, kept = {}, simjoin.cut
    monkeypatch.setattr(simjoin, "cut", lambda df, label="step": held.setdefault(label, kept(df, label)))
    found = simjoin.within_blocks(spark.createDataFrame(items, "block string, id long, seq string"), "block", 0.5, infix=infix, dna=False, digits=6)
    assert rows(found) == sorted(wanted)
    assert held["near"].count() <= len(names) ** 2
    monkeypatch.undo()
    once = simjoin.within_blocks(spark.createDataFrame(items[:60], "block string, id long, seq string"), "block", 0.5, infix=infix, dna=False)
    assert not once._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")  # no shuffle of pairs


def test_breadth_first_order(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5), (5, 4), (7, 8)], "u long, v long")
    found = graph.bfs_levels(edges, spark.createDataFrame([(1,), (7,), (9,)], "source long"))
    assert rows(found) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 2), (1, 5, 1), (7, 7, 0), (7, 8, 1), (9, 9, 0)]


def test_guard_of_crowded_pairs(spark):
    edges = spark.createDataFrame([("a", x, 1) for x in "cde"] + [("b", "f", 1), ("b", "f", 2), ("p", "q", 1)], "u string, v string, member int")
    pairs = spark.createDataFrame([("a", "b"), ("a", "p"), ("b", "p")], "a string, b string")
    assert rows(cluster.edge_member_guard(pairs, edges)) == [("b", "p")]


def test_guard_never_forms_pairs_of_nodes_and_edges(spark, monkeypatch):
    """Against a count by hand; 200 pairs of a node with 300 edges of one member are told by the node alone."""
    rng = random.Random(3)
    edges = list({(*sorted(rng.sample(range(30), 2)), rng.randrange(12)) for _ in range(90)}) + [(3, 3, 1), (7, 2, 4), (2, 7, None), (5, 7, None), (6, 7, None), (2, 8, None)]
    edges += [(100, 1000 + i, 1) for i in range(300)]
    pairs = [(a, b) for a in range(30) for b in range(a, 30)] + [(100, 2000 + i) for i in range(200)] + [(None, 1)]
    wanted = []
    for a, b in pairs:
        met = {}
        for u, v, m in set(edges):
            if {u, v} & {a, b}:
                met[m] = met.get(m, 0) + 1
        if max(met.values(), default=0) <= 3:
            wanted.append((a, b))
    held, kept = {}, cluster.cut
    monkeypatch.setattr(cluster, "cut", lambda df, label="step": held.setdefault(label, kept(df, label)))
    found = cluster.edge_member_guard(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(edges, "u long, v long, member long"))
    order = lambda x: (-1 if x[0] is None else x[0], x[1])
    assert sorted((tuple(r) for r in found.collect()), key=order) == sorted(wanted, key=order)
    assert 0 < len(wanted) < len(pairs)
    assert held["crowded"].where("node = 100").count() == 1
    assert held["held"].count() <= 2 * len(edges)


def test_search_space_of_families(spark):
    edges = spark.createDataFrame([("a", x) for x in "bcd"] + [("b", "c"), ("b", "d")], "u string, v string")
    members = spark.createDataFrame([("a", 1), ("b", 2)], "node string, member int")
    assert rows(cluster.search_space(edges, members)) == [("a",), ("b",)]
    assert rows(cluster.search_space(edges, members, spark.createDataFrame([(2,)], "member int"))) == [("b",)]


def test_families_never_hold_a_member_twice(spark):
    rng = random.Random(8)
    edges = [(f"n{i}", f"n{j}") for i in range(30) for j in range(i) if rng.random() < 0.2]
    members = [(f"n{i}", m) for i in range(30) for m in rng.sample(range(40), 3)]
    identities = [(f"n{j}", f"n{i}", 0.9) for i in range(30) for j in range(i) if rng.random() < 0.3]
    found = cluster.collapse_families(spark.createDataFrame(edges, "u string, v string"), spark.createDataFrame(members, "node string, member int"), spark.createDataFrame(identities, "x string, y string, ident double"))
    family = dict(map(tuple, found.collect()))
    held = {}
    for node, member in set(members):
        held.setdefault(family[node], []).append(member)
    assert all(len(set(m)) == len(m) for m in held.values()) and len(set(family.values())) < len(family)
    assert all(family[f] == f and f <= n for n, f in family.items())
    # By hand: at each depth, linked groups are split in order of support, and a part becomes its smallest node.
    wanted = {n: n for n in family}
    for depth in (1, 2, 3):
        near = {}
        for u, v in edges:
            u, v = wanted[u], wanted[v]
            if u != v:
                near.setdefault(u, set()).add(v)
                near.setdefault(v, set()).add(u)
        similar = {frozenset((wanted[x], wanted[y])) for x, y, _ in identities if wanted[x] != wanted[y]}
        reach = {n: {n} for n in near}
        for _ in range(depth):
            reach = {n: r.union(*(near[x] for x in r)) for n, r in reach.items()}
        root = {n: n for n in set(wanted.values())}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, r in reach.items():
            for b in r:
                if frozenset((a, b)) in similar:
                    a_, b_ = find(a), find(b)
                    root[max(a_, b_)] = min(a_, b_)
        own = {}
        for n, m in set(members):
            own.setdefault(wanted[n], set()).add(m)
        groups = {}
        for n in root:
            groups.setdefault(find(n), []).append(n)
        to = {}
        for nodes in groups.values():
            parts = []
            for n in sorted(nodes, key=lambda n: (-len(own.get(n, ())), n)):
                part = next((p for p in parts if not p[1] & own.get(n, set())), None)
                if part is None:
                    part = ([], set())
                    parts.append(part)
                part[0].append(n)
                part[1].update(own.get(n, set()))
            to |= {n: min(p) for p, _ in parts for n in p}
        wanted = {n: to[f] for n, f in wanted.items()}
    assert family == wanted


def test_both_strands_and_aligned_parts(spark):
    rng = random.Random(9)
    turn = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    one, two = dna(120), dna(120)
    changed = one[:50] + "A" + one[51:]
    items = spark.createDataFrame([("a", one), ("b", turn(changed)), ("c", two), ("d", two)], "id string, seq string")
    found = {(r.query, r.target): (round(r.ident, 3), r.reversed) for r in simjoin.similar_both_strands(items).collect()}
    assert found == {("a", "b"): (1.0 if changed == one else round(1 - 1 / 120, 3), True), ("c", "d"): (1.0, False)}
    target = dna(30) + turn(one[:60]) + dna(30)
    frame = spark.createDataFrame([(one[:60], target), (target[10:40], target), ("", target), (None, target)], "q string, t string")
    rows_ = [r.x for r in frame.select(sf.aligned_part(F.col("q"), F.col("t")).alias("x")).collect()]
    assert (rows_[0].identity, rows_[0].start, rows_[0].end, rows_[0].reversed, rows_[0].part) == (1.0, 30, 90, True, one[:60])
    assert (rows_[1].start, rows_[1].end, rows_[1].reversed, rows_[1].part) == (10, 40, False, target[10:40])
    assert rows_[2].part is None and rows_[3].identity is None


def test_one_genome_in_the_form_that_merges(spark):
    kind = "node_id long, label string, attributes map<string,string>"
    nodes = spark.createDataFrame([(0, "x", {"members": "7", "centroid": "['0_1']", "hasEnd": "True", "paralog": "0", "dna": "[ACG]"})], kind)
    edges = spark.createDataFrame([(0, 1, {"members": "7", "k": "v"})], "u long, v long, attributes map<string,string>")
    n, e = graph.single_genome(nodes, edges)
    assert n.first().attributes == {"members": "0", "centroid": "0_1", "dna": "ACG", "protein": "", "hasEnd": "1", "mergedDNA": "0", "paralog": "0"}
    assert e.first().attributes == {"k": "v", "members": "0", "genomeIDs": "0"}


def test_joined_finds_long_and_short_pairs_without_shuffling_kmers(spark, monkeypatch):
    """as many pairs as all comparisons give, and no step spreads sequences out into k-mers."""
    import random

    from graphfold.functions.distances import common_kmers, edits

    r = random.Random(9)
    changed = lambda s, rate: "".join("" if (z := r.random()) < rate / 2 else r.choice("abcdefgh") if z < rate else c for c in s)
    base = ["".join(r.choice("abcdefgh") for _ in range(n)) for n in (0, 3, 40, 90, 150, 260, 900)]
    shared = base[-1][:60]
    texts = [*base, *(changed(s, rate) for s in base for rate in (0.05, 0.2, 0.35)), base[2], base[2], base[6], shared + base[5], shared + base[4], "a" * 300, "a" * 300]
    items = [(f"i{k}", s) for k, s in enumerate(texts)] + [("none", None)]

    def wanted(one, two):
        for a, s in one:
            for b, t in two:
                n = max(len(s), len(t), 1)
                if (n <= 120 or common_kmers(s, t, 12) >= 8) and 1 - edits(s, t) / n >= 0.7:
                    yield a, b, round(1 - edits(s, t) / n, 6)

    frame = spark.createDataFrame(items, "id string, seq string")
    held = []
    kept = simjoin.cut
    monkeypatch.setattr(simjoin, "cut", lambda df, label="step": held.append(kept(df, label)) or held[-1])
    found = simjoin.joined(frame, short=120, k=12)
    got = sorted((x.query, x.target, round(x.ident, 6)) for x in found.collect())
    assert got == sorted(x for x in wanted(items[:-1], items[:-1]) if x[0] < x[1]) and len(got) > 15
    assert [x.count() for x in held][0] == len(texts) and "explode" not in found._jdf.queryExecution().optimizedPlan().toString()
    one, two = items[:20], items[15:-1]
    pair = [spark.createDataFrame(x, "id string, seq string") for x in (one, two)]
    got = sorted((x.query, x.target, round(x.ident, 6)) for x in simjoin.joined(*pair, short=120, k=12).collect())
    assert got == sorted(wanted(one, two)) and got


def test_edit_distances_and_their_bounds():
    import random

    import numpy as np

    from graphfold.functions import distances

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(4)
    for letters in ("ab", "abcdefghijklmnopqrst", "aé漢😀" + "".join(map(chr, range(300, 340)))):
        texts = ["", "a", *("".join(r.choice(letters) for _ in range(n)) for n in (5, 63, 64, 130, 200))]
        texts += ["".join(c for c in s if r.random() > 0.1) + "zz" for s in texts[2:]]
        texts = sorted({*texts}, key=len)
        group = distances.Group(texts)
        for x, a in enumerate(texts):
            known = [plain(a, b) for b in texts]
            assert [distances.edits(a, b) for b in texts] == known
            for band in (20, 1000):
                common = distances.subsequences(group, x, np.arange(len(texts)), band)
                assert all(2 * c >= len(a) + len(b) - 2 * d for b, c, d in zip(texts, common, known, strict=True) if d <= band)
            for b, d in zip(texts, known, strict=True):
                if 0 < len(a) <= len(b) <= len(a) + 30:
                    places = {c: sum(1 << i for i, y in enumerate(a) if y == c) for c in a}
                    got = distances.banded_edits(places, len(a), b, 30)
                    assert got == d if d <= 30 else got > 30


def test_sim_join_text_finds_long_texts_with_spread_out_edits(spark, tmp_path):
    """texts of over 700 letters at the threshold that have no long k-mer in common, by the query and by its SQL."""
    import random

    import duckdb

    from graphfold.functions.distances import common_kmers, edits
    from graphfold.plans import catalogue

    r = random.Random(12)
    changed = lambda s, every: "".join(r.choice("xyz") if i % every == 0 else "" if i % every == 7 else c for i, c in enumerate(s))
    base = ["".join(r.choice("abcdefghij") for _ in range(n)) for n in (800, 1100, 1500, 720)]
    texts = [*base, *(changed(s, every) for s in base for every in (9, 10, 14)), base[1], base[0][:560], base[2][300:], "", "", "a", None, "no letter: 1, 2"]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "doc_id long, text string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, base[3][:-100])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = sorted(tuple(x) for x in catalogue.QUERIES["sim_join_text"](spark, str(tmp_path)).collect())

    letters = {f"d{i}": "".join(c for c in s or "" if c.isalpha()) for i, s in enumerate(texts)} | {"b0": base[3][:-100]}
    pairs = [(a, b, 1 - edits(s, t) / max(len(s), len(t), 1)) for a, s in letters.items() for b, t in letters.items() if a < b]
    assert found == sorted((a, b, round(x, 6)) for a, b, x in pairs if x >= 0.7)
    lost = [x for x in found if max(len(letters[x[0]]), len(letters[x[1]])) > 700 and common_kmers(letters[x[0]], letters[x[1]], 40) < 8]
    assert len(lost) > 10
    database = duckdb.connect()
    for name in ("documents", "benchmark"):
        database.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert found == sorted(database.sql(catalogue.ORACLES["sim_join_text"]).fetchall())


@pytest.mark.parametrize("classes", [2, 3, 4])
def test_subsequences_of_any_number_of_classes_bound_the_edits(classes):
    """no pair at the threshold is refused, whatever its lengths, and those far off are."""
    import random

    import numpy as np

    from graphfold.functions import distances

    r = random.Random(classes)
    base = ["".join(r.choice("abcdefghijklmnopqrst") for _ in range(n)) for n in (0, 1, 5, 64, 130, 400)]
    texts = sorted([*base, *("".join("" if (z := r.random()) < rate / 2 else r.choice("abcz") if z < rate else c for c in s) for s in base for rate in (0.1, 0.3, 0.5)), *(s[: len(s) * 3 // 4] for s in base)], key=len)
    group, every = distances.Group(texts), np.arange(len(texts))
    refused = 0
    for x, a in enumerate(texts):
        near = {y for y, b in enumerate(texts) if 1 - distances.edits(a, b) / max(len(a), len(b), 1) >= 0.7}
        left = set(distances.possible(group, x, every, 0.7, (classes,)).tolist())
        assert near <= left
        refused += len(texts) - len(left)
        for y in every:
            whole = sum(distances.plain_subsequence(group, x, int(y), c, classes) for c in range(classes))
            assert distances.subsequences(group, x, np.array([y] * 3), 10_000, classes).tolist() == [whole] * 3
    assert refused > len(texts)
