"""The token field against enumeration, and held-out documents."""

import itertools

import numpy as np

from foliospark.llm import queries, toxicity

SF_DIR = "/root/testdata/sf0.01"


def a_model():
    names = np.array(sorted({f for w in ("idiot", "the", "cat", "you") for f in toxicity.features(w)}))
    rng = np.random.default_rng(3)
    return toxicity.Model(
        names, np.append(rng.normal(size=len(names)), 0.0), -0.3, rng.normal(size=(2, 2)), (0.0, 1.0, 0.0)
    )


def marginals(words, model):
    """By adding up all 2 ** n labellings of one chain."""

    def weight(feature):
        at = np.flatnonzero(model.names == feature)
        return model.weights[at[0]] if len(at) else 0.0

    e = []
    for i, w in enumerate(words):
        own = toxicity.features(w)
        x = sum(map(weight, own[:-2])) + model.bias
        if i:
            x += weight(toxicity.features(words[i - 1])[-2])
        if i + 1 < len(words):
            x += weight(toxicity.features(words[i + 1])[-1])
        e.append(x)
    total, each = 0.0, np.zeros(len(words))
    for ys in itertools.product((0, 1), repeat=len(words)):
        s = sum(x * y for x, y in zip(e, ys)) + sum(model.transition[a, b] for a, b in zip(ys, ys[1:]))
        total += np.exp(s)
        each += np.exp(s) * np.array(ys)
    return each / total


def test_marginals_by_enumeration():
    model = a_model()
    text = "the idiot. you cat the unknown idiot you\ncat! . idiot"
    score, spans = toxicity.Tagger(model).tag([text, "", "the"])
    p = np.concatenate([
        marginals(s, model)
        for s in (["the", "idiot"], ["you", "cat", "the", "unknown", "idiot", "you"], ["cat"], ["idiot"])
    ])
    total = -np.log1p(-p).sum()
    assert np.isclose(score[0], 1 / (1 + np.exp(-np.log(total + 1e-4))))
    assert np.isclose(score[1], 1 / (1 + np.exp(-np.log(1e-4))))
    want = [(m.start(), m.end()) for m in toxicity.TOKEN.finditer(text) if m[0] not in toxicity.ENDS]
    hot = {w for w, x in zip(want, p) if x >= 0.5}
    covered = {w for w in want if any(a <= w[0] and w[1] <= b for a, b, _ in spans[0])}
    assert covered == hot


def test_held_out(spark):
    got = queries.op4_toxicity(spark, SF_DIR)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert got.count() == docs.count()
    rows = [r for r in got.join(labels, "doc_id").collect() if r.held_out]
    positive = [r.score for r in rows if r.toxic == 1]
    negative = [r.score for r in rows if r.toxic == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in positive for b in negative])
    assert auc > 0.7 and np.mean([r.predicted == r.toxic for r in rows]) > 0.95
    words = got.filter("predicted = 1").join(docs, "doc_id").selectExpr(
        "substring(text, spans[0].start + 1, spans[0].end - spans[0].start) as w"
    )
    assert words.filter("w rlike '(?i)idiot|trash|scum|moron'").count() > 0


def test_edges(spark):
    schema = "doc_id long, text string, toxic int, score string, spans string"
    rows = [(i, "you idiot go away now" if i % 3 else "the cat sat on a mat", int(i % 3 > 0), "x", None) for i in range(60)]
    rows += [(100, None, 1, "x", None), (101, "", 0, "x", None), (None, "the cat", None, None, None),
             (102, "cat " * 30_000, None, "x", None), (102, "cat " * 30_000, None, "x", None)]
    df = spark.createDataFrame(rows, schema)
    model = toxicity.fit(df, "doc_id", "text", "toxic")
    out = toxicity.score(df, "doc_id", "text", model)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows)
    assert got[1].predicted == 1 and got[0].predicted == 0 and got[100].score == got[101].score
    assert got[None].predicted == 0 and all(0 <= r.score <= 1 for r in got.values())
    kept = toxicity.keep_clean(df, "text", model)
    assert kept.columns == df.columns and kept.count() == sum(1 - r.predicted for r in out.collect())
    none = toxicity.fit(df.filter("false"), "doc_id", "text", "toxic")
    assert {r.predicted for r in toxicity.score(df, "doc_id", "text", none).collect()} == {0}
    assert toxicity.score(df.limit(0), "doc_id", "text", model).count() == 0


def test_texts_are_measured_below_the_join(spark):
    """Texts stay out of the join that chooses the sample."""
    rows = toxicity.measured(queries.labelled(spark, SF_DIR), "doc_id", "text", "size")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("octet_length")
