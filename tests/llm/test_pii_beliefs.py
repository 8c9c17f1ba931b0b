"""Labels of mentions by belief, in every document."""

import numpy as np

from prosestat.llm import pii


def test_documents_without_base_spans_are_labelled_by_belief(spark, sf):
    address = "jo [at] mail.example.com"
    rows = [(1, f"write {address} or {address} soon"), (2, "order 8812345 of 7654321"), (3, f"host 10.1.2.3, write {address} or {address}")]
    own = spark.createDataFrame([(-i, t) for i, t in rows], "doc_id long, text string")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(own)
    got = {-r["doc_id"]: r for r in pii.find(docs).where("doc_id < 0").collect()}
    at = rows[0][1].index(address), rows[0][1].rindex(address)
    assert got[1]["spans"] == ",".join(f"email:{s}:{s + len(address)}" for s in at) and got[1]["added"] == 2
    assert got[2]["spans"] == ""
    assert got[3]["added"] == 2  # its base span is another entity


def test_unary_weights_alone_add_a_span():
    crf = pii.Crf()
    crf.unary[1 + pii.KINDS.index("phone"), 8] = 9.0  # 7 to 11 digits
    text = "ring 212 555 0100 now"
    assert pii.base_spans(text) == [] and pii.added_spans(text, [], crf) == [(5, 3, 17)]
    assert pii.added_spans(text, [], pii.Crf()) == []
    assert pii.added_spans("no numbers", [], crf) == []


def test_a_label_reaches_the_last_of_many_repeats():
    crf, n = pii.Crf(), 400
    crf.skip += 6 * np.eye(pii.LABELS)
    crf.unary[pii.NONE, 0] = 0.0005
    text = "+1 (212) 555-0100 and " + "; ".join(["212 555-0100"] * n)
    base = pii.base_spans(text)
    assert len(base) == 1
    found = pii.mentions(text, base)
    feats = np.stack([pii.unary(text, s, e) for s, e, _ in found])
    clamped = np.array([label for *_, label in found])
    got = crf.marginals(feats, clamped, [], pii.skips(text, found)[0], [])
    # Forward and backward along the chain, exactly: no loops.
    node = feats @ crf.unary.T
    node[0] = np.where(np.arange(pii.LABELS) == clamped[0], 0.0, -30.0)
    node, pot = np.exp(node - node.max(axis=1, keepdims=True)), np.exp(crf.skip)
    fore, aft = [node[0]], [np.ones(pii.LABELS)]
    for v in node[1:]:
        m = fore[-1] @ pot * v
        fore.append(m / m.sum())
    for v in node[:0:-1]:
        m = pot @ (v * aft[-1])
        aft.append(m / m.sum())
    want = np.array(fore) * np.array(aft[::-1])
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-3)
    assert got[13:40].argmax(axis=1).tolist() == [4] * 27


def test_beliefs_settle_with_loops():
    rng = np.random.default_rng(3)
    crf, n = pii.Crf(), 60
    crf.chain, crf.skip = -4 * np.eye(pii.LABELS), 4 * np.eye(pii.LABELS)
    crf.unary = rng.normal(size=crf.unary.shape)
    feats = rng.integers(0, 2, (n, pii.FEATURES)).astype(float)
    skip = [(i, i + 3) for i in range(n - 3)]
    p = crf.marginals(feats, np.full(n, -1), [(i, i + 1) for i in range(n - 1)], skip, [])
    assert np.isfinite(p).all() and np.allclose(p.sum(axis=1), 1)


def test_training_reads_every_mention():
    text = "; ".join(f"{7000000 + 1117 * k}" for k in range(200))
    assert len(pii.cases(text)) == 200
    rows = pii.cases(pii.made_up(1)[0][0])
    once, twice = (pii.Crf().fit(rows, np.full(len(rows), w)) for w in (1.0, 2.0))
    assert np.allclose(once.unary, twice.unary)


def test_marginals_are_exact_on_trees():
    """Against the sum over all labellings, on small graphs without loops of all kinds of links."""
    from itertools import product

    rng = np.random.default_rng(6)
    for n in (1, 2, 4, 5):
        crf = pii.Crf()
        crf.unary = rng.normal(size=crf.unary.shape)
        pots = []
        for name in ("chain", "skip", "near"):
            w = rng.normal(size=(pii.LABELS, pii.LABELS))
            setattr(crf, name, (w + w.T) / 2)
            pots.append(getattr(crf, name))
        feats = rng.integers(0, 2, (n, pii.FEATURES)).astype(float)
        clamped = np.full(n, -1)
        clamped[0] = 2
        kinds = [[], [], []]
        for i in range(1, n):
            kinds[int(rng.integers(3))].append((int(rng.integers(i)), i))
        want, node = np.zeros((n, pii.LABELS)), feats @ crf.unary.T
        for y in product(range(pii.LABELS), repeat=n):
            if y[0] == 2:
                e = sum(node[i, y[i]] for i in range(1, n)) + sum(w[y[a], y[b]] for w, links in zip(pots, kinds, strict=True) for a, b in links)
                for i in range(n):
                    want[i, y[i]] += np.exp(e)
        got = crf.marginals(feats, clamped, *kinds)
        assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-3)


def test_links_of_repeats_and_similar_mentions():
    text = "jo@mail.example.com or +1 (212) 555-0100; al@mail.example.com, 212-555-0100; 313 555 0100"
    found = pii.mentions(text, pii.base_spans(text))
    said = [text[s:e] for s, e, _ in found]
    same, near = pii.skips(text, found)
    assert [(said[a], said[b]) for a, b in same] == [("+1 (212) 555-0100", "212-555-0100")]
    assert [(said[a], said[b]) for a, b in near] == [("jo@mail.example.com", "al@mail.example.com"), ("212-555-0100", "313 555 0100")]


def test_planted_repeats_are_found(spark, sf):
    """Entities of which one mention is a base span: nine in ten of their other forms are found,
    and numbers of other kinds are left alone."""
    made = pii.made_up(300, seed=99)
    own = spark.createDataFrame([(-1 - k, t) for k, (t, _) in enumerate(made)], "doc_id long, text string")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(own)
    caught = total = wrong = 0
    for r in pii.find(docs).where("doc_id < 0").collect():
        text, truth = made[-1 - r["doc_id"]]
        base = {(s, e) for s, _, e in pii.base_spans(text)}
        said = {(int(s), int(e)): 1 + pii.KINDS.index(k) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)}
        known = {truth[at] for at in base if at in truth}
        hidden = [at for at, label in truth.items() if at not in base and label in known]
        total += len(hidden)
        caught += sum(said.get(at) == truth[at] for at in hidden)
        wrong += sum(at not in base and truth.get(at) != label for at, label in said.items())
    assert total > 200 and caught >= 0.9 * total and wrong <= 0.02 * total


def test_a_number_that_only_looks_like_a_phone_is_left_alone():
    cases = np.concatenate([pii.cases(t, truth) for t, truth in pii.made_up(pii.SAMPLE)])
    crf = pii.Crf().fit(*np.unique(cases, axis=0, return_counts=True))
    for number in ("212 555-0100", "212-555-0100", "212.555.0100"):
        assert pii.added_spans(f"or {number} later", [], crf) == []
        text = f"call +1 (212) 555-0100, or {number} later"
        assert pii.added_spans(text, pii.base_spans(text), crf) == [(27, 3, 39)]
