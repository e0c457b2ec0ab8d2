"""Near copies and the pipeline against brute force."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import nearcopies, quality, queries, setlinks
from tallyforge.llm.common import table

from .test_operators import SPACES, check_packing, lower, rows, split

SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    w = split(lower(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def plain_groups(texts):
    """The group of each text by comparing all pairs of shingle sets."""
    sets = [shingles(t) if split(t) else set() for t in texts]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_near_groups(documents, hostile, empty):
    for docs, dense in ((documents, 128), (documents, 3), (hostile, 128), (hostile, 2)):
        plain = docs.collect()
        label = plain_groups([r["text"] for r in plain])
        least = defaultdict(list)
        for r, g in zip(plain, label):
            least[g].append(r["doc_id"])
        want = Counter((r["doc_id"], min((i for i in least[g] if i is not None), default=None)) for r, g in zip(plain, label))
        assert Counter((r["doc_id"], r["component_id"]) for r in nearcopies.near_groups(docs, dense=dense).collect()) == want
    assert nearcopies.near_groups(empty).count() == 0
    stay = rows(nearcopies.drop_near_copies(hostile))
    assert len({r["doc_id"] for r in stay}) == len(stay) and set(stay[0]) == set(hostile.columns)


def test_every_stage_on_hostile_rows(spark, hostile):
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, hostile, SF)
        if name != "best_fit_packing":
            assert after.columns == hostile.columns
            assert after.exceptAll(hostile).count() == 0
            n = Counter(r["text"] for r in after.collect())
            if name == "exact_dedup":
                assert max(n.values()) == 1
        else:
            assert after.where("doc_id = 11").count() > 4
        assert after.count() > 0


def test_quality_stage_against_brute_force(spark, documents, labels):
    """The stage keeps what the scores say, and the scores are those of the trees walked node by node over plain counts."""
    seen = []
    fit = quality.fit
    quality.fit = lambda *a: seen.append(fit(*a)) or seen[-1]
    try:
        got = {r["doc_id"]: r["score"] for r in quality.quality_scores(documents, labels).collect()}
        stay = {r["doc_id"] for r in corpus_pipeline.quality_stage(spark, documents, SF).collect()}
    finally:
        quality.fit = fit
    model = seen[0]
    for r in documents.collect():
        t = r["text"] or ""
        w, lines = split(t), [x for x in t.split("\n") if split(x)]
        of = lambda chars: sum(c in chars for c in t)
        upper = sum("A" <= c <= "Z" or "À" <= c <= "Ö" or "Ø" <= c <= "Þ" for c in t)
        raw = [len(w), sum(map(len, w)), of("#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(set(w)), upper, sum(c in "0123456789" for c in t), of("!?"), of("|"), of(".,;:"), len(t)]
        x = quality.features(np.array([raw]))[0]
        total = model.base
        for root in model.roots:
            at = root
            while model.left[at] >= 0:
                j = model.feature[at]
                at = model.left[at] + (np.searchsorted(model.edges[j], x[j], "right") > model.limit[at])
            total += model.value[at]
        score = 1 / (1 + np.exp(-total))
        assert abs(got[r["doc_id"]] - score) < 1e-9
        assert (r["doc_id"] in stay) == (score >= 0.7)


def test_near_copies_are_found_and_others_left(spark):
    rng = np.random.default_rng(9)
    vocab = [f"w{i}" for i in range(5000)]
    texts = []
    for k in range(60):
        base = [vocab[i] for i in rng.integers(0, 5000, 400)]
        texts.append((2 * k, " ".join(base)))
        for at in rng.choice(380, 4, replace=False):
            base[at] = "changed"
        texts.append((2 * k + 1, " ".join(base)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_groups(docs).collect()}
    sim = [len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for (_, a), (_, b) in zip(texts[::2], texts[1::2])]
    assert min(sim) > 0.85
    assert all(got[2 * k + 1] == 2 * k for k in range(60))
    assert all(got[i] in (i, i - i % 2) for i in got)


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    before = docs
    for (name, stage), label in zip(corpus_pipeline.STAGES, ("quality", "exact", "near", "mix", "pack")):
        after = stage(spark, before, SF).cache()
        if label != "pack":
            assert after.columns == names and after.exceptAll(before).count() == 0
        if label == "exact":
            assert sorted(SPACES.sub(" ", r["text"] or "") for r in after.collect()) == sorted({SPACES.sub(" ", r["text"] or "") for r in before.collect()})
        if label == "mix":
            con = duckdb.connect()
            con.register("documents", before.toPandas())
            sql = queries.mixing_sql((9, 10), 1)
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(r[0] for r in con.execute(f"SELECT doc_id FROM ({sql})").fetchall())
        if label == "pack":
            check_packing(rows(after), before.collect(), 2048)
        before = after
    assert corpus_pipeline.run(spark, SF).count() == before.count() > 0
    empty = docs.where(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def edited_pairs(count, edits, seed=11):
    """(doc_id, text) of pairs 2 k and 2 k + 1 of 400 words that differ in so many words far apart, and their similarities."""
    rng = np.random.default_rng(seed)
    texts, sim = [], []
    for k in range(count):
        base = [f"w{i}" for i in rng.integers(0, 5000, 400)]
        copy = list(base)
        for j, at in enumerate(np.linspace(5, 390, edits[k % len(edits)]).astype(int)):
            copy[at] = f"changed{k}x{j}"
        texts += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        a, b = shingles(texts[-2][1]), shingles(texts[-1][1])
        sim.append(len(a & b) / len(a | b))
    return texts, sim


def test_texts_below_the_similarity_are_not_joined(spark):
    texts, sim = edited_pairs(200, (9, 10, 11))
    assert 0.74 < min(sim) and any(s < 0.8 for s in sim)
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert not [s for k, s in enumerate(sim) if s < 0.8 and got[2 * k + 1] == 2 * k]


def test_all_texts_of_the_similarity_are_joined_at_any_size(spark):
    texts, sim = edited_pairs(200, (3, 5, 7, 8))
    assert 0.8 < min(sim) < 0.82
    rng = np.random.default_rng(3)
    others = [(1000 + i, " ".join(f"w{x}" for x in rng.integers(0, 5000, 60))) for i in range(3000)]
    for docs in (texts, texts + others):
        got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert all(got[i] == i - i % 2 if i < 1000 else got[i] == i for i in got)


def test_near_groups_of_long_lists(spark):
    """Chains of edits around one text, and a passage that texts with nothing else in common share: as by brute force."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 5000, 200)]
    texts = []
    for i in range(60):
        own = list(base)
        for at in rng.choice(200, i % 9, replace=False):
            own[at] = f"e{i}x{at}"
        texts.append(" ".join(own))
    passage = [f"p{i}" for i in range(100)]
    texts += [" ".join(passage + [f"q{i}x{j}" for j in range(10 + i)]) for i in range(60)]
    sets = [shingles(t) for t in texts]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for dense in (128, 4):
        got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_groups(docs, dense=dense).collect()}
        assert [got[i] for i in range(len(texts))] == label
    assert 2 < len(set(label)) < len(texts)


def test_near_copies_are_found_by_fingerprints(spark, monkeypatch):
    """With nothing but the fingerprints: pairs within the radius are joined if their sets are alike, at any radius, and no others."""
    texts, sim = edited_pairs(200, (1, 2, 9, 10))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sets = [nearcopies.shingle_set(t) for _, t in texts]
    fps = [plain_fold(s) for s in sets]
    none = docs.select(*[F.col("doc_id").alias(c) for c in ("node", "root", "lead")]).where("false")
    monkeypatch.setattr(nearcopies, "candidate_groups", lambda *a, **k: none)
    for radius in (4, 8):
        got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_groups(docs, radius=radius).collect()}
        want = [s >= 0.8 and (a ^ b).bit_count() <= radius for s, a, b in zip(sim, fps[::2], fps[1::2])]
        assert [got[2 * k + 1] == 2 * k for k in range(200)] == want and all(got[2 * k] == 2 * k for k in range(200))
        assert 50 < sum(want) < 150
    assert any(s < 0.8 and (a ^ b).bit_count() <= 8 for s, a, b in zip(sim, fps[::2], fps[1::2]))


def plain_fold(hashes):
    n = [sum(int(h) >> i & 1 for h in hashes) for i in range(64)]
    return sum(1 << i for i in range(64) if 2 * n[i] > len(hashes))


def test_texts_that_fingerprints_joined_are_not_compared_again(spark):
    groups = spark.createDataFrame([(1, 10, 1), (2, 10, 1), (3, 10, 1), (4, 11, 4), (5, 11, 4), (1, 12, 1), (6, 12, 1)], "node long, root long, lead long")
    found = spark.createDataFrame([(2, 1), (3, 1), (5, 0)], "node long, root long")
    assert sorted({r["root"] for r in nearcopies.not_joined(groups, found).collect()}) == [11, 12]


def test_blocks_of_a_long_group_are_tasks_of_their_own(spark, monkeypatch):
    """A group's blocks don't follow its root to one task, whichever join Spark takes."""
    seen, long = [], setlinks._long
    monkeypatch.setattr(setlinks, "_long", lambda *a: seen.append(long(*a)) or seen[-1])
    monkeypatch.setattr(setlinks, "BLOCK", 5)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        sets = spark.range(40).select(F.col("id").alias("node"), F.array(*[F.col("id") * 100 + i for i in range(20)]).alias("items"))
        groups = spark.range(40).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("root"), F.lit(0).cast("long").alias("lead"))
        assert setlinks.set_links(sets, groups, 4, 5, 8).count() == 0
        plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert re.search(r"Exchange hashpartitioning\(root#\d+L?, r#\d+, c#\d+", plan[plan.index("hashpartitioning") - 9 : plan.index("SortMergeJoin")])
    assert "FlatMapGroupsInPandas" not in plan  # a whole block would be one batch
