"""Tree, index, classification and reports on a small tree, against plain models."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandex.constants import AMBIGUOUS, CORE_DOMAINS
from strandex.operators import classify, domains, index, minimizers, reports, taxonomy
from strandex.streaming.reads import classify_batch, classify_stream
from tests.test_minimizers import plain, plain_runs

KK, LL = 15, 11
#: 20 and 30 below bacteria; 21, 22 below 20, 211 below 21; 40 below viruses; 99 reaches no root.
EDGES = [(20, 2), (21, 20), (22, 20), (211, 21), (30, 2), (31, 30), (40, 10239), (41, 40), (99, 98), (98, 99)]
PARENT = {1: 1, 131567: 1, 10239: 1, 2: 131567, 2157: 131567, 4751: 131567} | {t: p for t, p in EDGES if t not in (98, 99)}


def up(t):
    out = [t]
    while out[-1] != 1:
        out.append(PARENT[out[-1]])
    return out[::-1]


@pytest.fixture(scope="module")
def tree(spark):
    nodes = taxonomy.with_domains(spark.createDataFrame(EDGES, "taxid long, parent long"))
    paths = taxonomy.lineages(nodes).cache()
    return nodes, paths


def test_tree(spark, tree):
    nodes, paths = tree
    assert {r.taxid: r.lineage for r in paths.collect()} == {t: up(t) for t in PARENT}
    targets = spark.createDataFrame([(20,), (21,), (31,), (7,)], "taxid long")
    near = {t: next((x for x in up(t)[::-1] if x in (20, 21, 31)), None) for t in PARENT}
    assert {r.taxid: r.target for r in taxonomy.rollup(paths, targets).collect()} == {t: x for t, x in near.items() if x}
    got = {(r.anc, r.desc, r.depth) for r in taxonomy.closure(paths, spark.createDataFrame([(1,), (20,), (211,)], "taxid long")).collect()}
    assert got == {(1, 1, 0), (1, 20, 0), (20, 20, 3), (1, 211, 0), (20, 211, 3), (211, 211, 5)}


def test_lca_aggregate(spark, tree):
    rnd = random.Random(3)
    rows = [(g, rnd.choice([*PARENT, 555])) for g in range(60) for _ in range(rnd.randint(1, 4))]
    want = {}
    for g, t in rows:
        if t in PARENT:
            path = up(t)
            want[g] = path if g not in want else [x for x, y in zip(want[g], path) if x == y]
    frame = spark.createDataFrame(rows, "g int, taxid long")
    got = {r.g: r.taxid for r in taxonomy.lca_aggregate(frame, ["g"], taxonomy.numbered(tree[1])).collect()}
    assert got == {g: p[-1] for g, p in want.items()}


def test_domain_rules(spark):
    cases = {(2,): 2, (2, 10239): 1, (2, 4751): 131567, (10239,): 10239, (2, 2157, 10239): 1}
    frame = spark.createDataFrame([(list(k),) for k in cases], "t array<long>")
    assert {tuple(r.t): r.x for r in frame.select("t", taxonomy.domain_lca(F.col("t")).alias("x")).collect()} == cases


def world():
    rnd = random.Random(11)
    base = ["".join(rnd.choice("ACGT") for _ in range(60)) for _ in range(12)]
    records, taxa = [], {}
    for i in range(14):
        name = f"acc{i}"
        if i < 12:
            taxa[name] = rnd.choice([21, 211, 22, 31, 30, 41, 20, 9999])
        records.append((name, "".join(rnd.sample(base, 3)) + "".join(rnd.choice("ACGTN") for _ in range(40))))
    reads = []
    for i in range(60):
        src = rnd.choice(records)[1]
        at = rnd.randrange(len(src) - 50)
        reads.append((i, 1, f"read{i} x", src[at : at + rnd.choice([10, 30, 50])]))
        reads.append((i, 2, f"read{i} y", "".join(rnd.choice([src[j : j + 25], "N", "ACGTTGCATG"]) for j in range(0, 60, 20))))
    return records, taxa, reads


TARGETS = {20, 21, 31}


def model_index(records, taxa):
    rolled = {t: next((x for x in up(t)[::-1] if x in TARGETS), None) for t in PARENT}
    own, others, who = defaultdict(set), set(), defaultdict(set)
    for name, seq in records:
        found = {m for m in plain(seq, KK, LL) if m is not None}
        t = taxa.get(name)
        if rolled.get(t):
            for m in found:
                own[m].add(t)
                who[m].add(name)
        else:
            others |= found
    out = {}
    for m, ts in own.items():
        path = up(next(iter(ts)))
        for t in ts:
            path = [x for x, y in zip(path, up(t)) if x == y]
        if m not in others and rolled[path[-1]]:
            out[m] = rolled[path[-1]]
    return out, {m: who[m] for m in out}


def model_read(mates, idx, taxa, background):
    weights, groups, back = Counter(), 0, 0
    for seq in mates:
        last = None
        for m, n in plain_runs(plain(seq, KK, LL)):
            t = idx.get(m, background.get(m)) if m is not None else None
            if t is None:
                continue
            weights[t] += n
            if m != last:
                groups, back = (groups + 1, back) if m in idx else (groups, back + 1)
            last = m
    if not weights or groups + max(back - 1, 0) < 2:
        return "U", None, None
    pw = {d: sum(w for j, w in weights.items() if j in up(d)) for d in taxa}
    best = sorted(d for d in taxa if pw[d] == max(pw.values()))
    if len(best) == 1:
        return "C", best[0], None
    shared = [t for t in up(best[0]) if t in taxa and all(t in up(b) for b in best)]
    if not background:
        shared = [t for t in shared if t not in CORE_DOMAINS]
    return ("C", shared[-1], None) if shared else ("A", None, best)


@pytest.fixture(scope="module")
def built(spark, tree):
    records, taxa, reads = world()
    frame = spark.createDataFrame(records, "accession string, seq string")
    acc = spark.createDataFrame(list(taxa.items()), "accession string, taxid long")
    targets = spark.createDataFrame([(t,) for t in TARGETS], "taxid long")
    idx = index.build(frame, acc, tree[0], targets, k=KK, l=LL).cache()
    return frame, acc, targets, idx, spark.createDataFrame(reads, "read_id long, mate int, header string, seq string")


def test_index(built):
    records, taxa, _ = world()
    want, _ = model_index(records, taxa)
    assert want and {r.minimizer: r.taxid for r in built[3].collect()} == want


def test_saved_index(spark, built, tmp_path):
    index.save(built[3], str(tmp_path), KK, LL)
    again, k, l = index.load(spark, str(tmp_path))
    assert (k, l) == (KK, LL) and again.count() == built[3].count()
    index.save(built[3].limit(0), str(tmp_path), KK, LL)
    with pytest.raises(ValueError):
        index.load(spark, str(tmp_path))


@pytest.mark.parametrize("with_domains", [False, True])
def test_classification(spark, tree, built, with_domains):
    records, taxa, reads = world()
    idx, _ = model_index(records, taxa)
    background, fallback = {}, None
    if with_domains:
        rnd = random.Random(4)
        seen = sorted({m for _, s in records for m in plain(s, KK, LL) if m is not None})
        background = {m: rnd.choice([1, 2, 10239, 131567]) for m in seen if rnd.random() < 0.7}
        fallback = spark.createDataFrame(list(background.items()), "minimizer long, taxid long")
    known = sorted(set(idx.values()) | set(CORE_DOMAINS))
    want = {i: model_read([s for j, _, _, s in reads if j == i], idx, known, background) for i in range(60)}
    runs = minimizers.read_runs(built[4], KK, LL)
    found = classify.lookup(runs, built[3], fallback).cache()
    closure = taxonomy.closure(tree[1], taxonomy.index_taxa(built[3].select("taxid").distinct()))
    decided = classify.all_reads(built[4], classify.classify(classify.hit_weights(found), closure, with_domains)).cache()
    assert {r.read_id: (r.status, r.taxid, r.best) for r in decided.collect()} == want
    assert len({s for s, _, _ in want.values()}) >= 2

    shown = {r.read_id: r.pattern for r in classify.patterns(found).collect()}
    for i in range(60):
        text = []
        for seq in [s for j, _, _, s in reads if j == i]:
            spans = []
            for m, n in plain_runs(plain(seq, KK, LL)):
                t = (idx.get(m) or background.get(m, 0)) if m is not None else 0
                if spans and spans[-1][0] == t:
                    spans[-1][1] += n
                else:
                    spans.append([t, n])
            text.append("".join(f"{t}:{n} " for t, n in spans))
        if all(text):
            assert shown[i] == "|:| ".join(text)
    lines = classify.output_lines(built[4], decided, classify.patterns(found)).collect()
    assert len(lines) == 60 and all(len(r.line.split("\t")) == 5 for r in lines)

    names = index.core_names(spark.createDataFrame([(20, "twenty")], "taxid long, name string"))
    rows = {r.taxid: r for r in reports.report(decided, names).collect()}
    counts = Counter(AMBIGUOUS if s == "A" else t for s, t, _ in want.values() if s != "U")
    assert {t: r.reads for t, r in rows.items()} == counts
    assert all(r.ratio == r.reads / 60 for r in rows.values())
    total = reports.status_counts(decided).first()
    assert total.classified + total.unclassified + total.ambiguous == total.total == 60
    if not with_domains:
        batch = {r.read_id: r.status for r in classify_batch(built[4], built[3], closure, k=KK, l=LL).collect()}
        assert batch == {i: s for i, (s, _, _) in want.items()}


def test_accessions_and_strains(spark, tree, built):
    records, taxa, reads = world()
    idx, who = model_index(records, taxa)
    rolled = taxonomy.rollup(tree[1], built[2])
    ids = index.accession_ids(index.target_accessions(built[1], rolled), tree[1]).cache()
    near = {t: next(x for x in up(t)[::-1] if x in TARGETS) for t in PARENT if TARGETS & set(up(t))}
    order = sorted((a for a, t in taxa.items() if t in near), key=lambda a: (up(near[taxa[a]]), a))
    number = {a: i for i, a in enumerate(order)}
    assert {r.accession: r.acc_id for r in ids.collect()} == number
    sets = index.accession_sets(built[0], built[3], ids, KK, LL).cache()
    assert {r.minimizer: r.acc_ids for r in sets.collect()} == {m: sorted(number[a] for a in names) for m, names in who.items()}
    classes = index.equivalence_classes(sets).cache()
    want = sorted(Counter(tuple(sorted(number[a] for a in names)) for names in who.values()).items())
    assert [(tuple(r.acc_ids), r.minimizers) for r in classes.orderBy("class_id").collect()] == want
    stats = reports.class_stats(classes).first()
    sizes = sorted(len(k) for k, _ in want)
    assert (stats.classes, stats.min_size, stats.max_size, stats.accession_refs) == (len(sizes), sizes[0], sizes[-1], sum(sizes))
    seen = {m for _, _, _, s in reads for m in plain(s, KK, LL)} & set(who)
    total, unique = Counter(a for m in seen for a in who[m]), Counter(a for m in seen if len(who[m]) == 1 for a in who[m])
    got = {r.accession: (r.total_hits, r.unique_hits) for r in reports.strain(minimizers.read_runs(built[4], KK, LL), sets, ids).collect()}
    assert got == {a: (n, unique[a]) for a, n in total.items()}
    assert reports.strain_lines(reports.strain(minimizers.read_runs(built[4], KK, LL), sets, ids)).columns == ["Accession", "Total_Hits", "Unique_Hits"]


def test_inspection_lines(spark, built):
    names = index.core_names(spark.createDataFrame([(20, "twenty")], "taxid long, name string"))
    rows = index.with_total(index.inspect(built[3], names)).collect()
    assert rows[0].TaxID == "Total" and rows[0].Minimizer_Count == built[3].count() == sum(r.Minimizer_Count for r in rows[1:])


def test_domains(spark, tree):
    rnd = random.Random(6)
    records = [(rnd.choice(["bacteria", "viral", "fungi", "all"]), f"{'kraken:taxid|41|' if i % 3 == 0 else f'a{i}'} x", "".join(rnd.choice("ACG") for _ in range(30))) for i in range(40)]
    frame = spark.createDataFrame(records, "domain string, header string, seq string")
    acc = spark.createDataFrame([("a1", 31), ("a2", 777), ("a4", 41)], "accession string, taxid long")
    named = domains.grouped(frame, acc, tree[1])
    by = {"a1": "bacteria", "a4": "viral"}
    want = Counter(d if d != "all" else "viral" if h.startswith("kraken") else by.get(h.split()[0], "other") for d, h, _ in records)
    assert {r.domain: r.records for r in domains.record_counts(named).collect()} == want
    pairs = domains.domain_minimizers(named.select("domain", "seq"), KK, LL).cache()
    of = defaultdict(set)
    for r in pairs.collect():
        of[r.minimizer].add(r.domain)
    assert {r.minimizer: r.domain for r in domains.exclusive(pairs).collect()} == {m: next(iter(d)) for m, d in of.items() if len(d) == 1}
    filters = domains.bloom_filters(pairs, 0.001).cache()
    hits = {(r.minimizer, r.domain) for r in domains.maybe_in(pairs, filters).collect()}
    members = {(m, d) for m, ds in of.items() for d in ds}
    assert members <= hits and len(hits - members) <= 0.02 * len(members) + 3
    exact, rough = Counter(d for ds in of.values() for d in ds), {r.domain: r.minimizers for r in domains.approximate_counts(pairs).collect()}
    assert all(abs(rough[d] - n) <= 0.05 * n + 1 for d, n in exact.items())
    merged = domains.merged_count(domains.sketches(pairs)).first().minimizers
    assert abs(merged - len(of)) <= 0.05 * len(of) + 1


def test_stream(spark, tree, built, tmp_path):
    built[4].coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(built[4].schema).parquet(str(tmp_path / "in"))
    closure = taxonomy.closure(tree[1], taxonomy.index_taxa(built[3].select("taxid").distinct()))
    job = classify_stream(stream, built[3], closure, lambda df, n: df.write.parquet(str(tmp_path / "out" / str(n))), str(tmp_path / "state"), KK, LL).start()
    job.processAllAvailable()
    job.stop()
    got = {r.read_id: r.status for r in spark.read.parquet(str(tmp_path / "out" / "0")).collect()}
    assert got == {r.read_id: r.status for r in classify_batch(built[4], built[3], closure, k=KK, l=LL).collect()}
