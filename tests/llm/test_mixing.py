import hashlib
from collections import Counter, defaultdict

from veilframe.llm import mixing
from veilframe.llm.mixing import Mix


def water_fill(budget, children):
    """{name: share} for {name: (weight, capacity)}: repeat until no child is over capacity."""
    share, open_ = {}, dict(children)
    while open_:
        total = sum(w for w, _ in open_.values())
        full = {n: c for n, (w, c) in open_.items() if w and c * total <= budget * w}
        if not full:
            for n, (w, c) in open_.items():
                share[n] = min(budget * w // total, c) if total else 0
            break
        for n, c in full.items():
            share[n] = c
            budget -= c
            del open_[n]
    return share


def brute(rows, mix):
    """{(doc_id, epoch)} by filling the tree and walking each leaf in order."""
    leaves = defaultdict(list)
    for i, text, lang, source in rows:
        n = len((text or "").split())
        digits = source[len(source.rstrip("0123456789")):] if source else ""
        domain = mix.domains[int(digits) % len(mix.domains)] if digits else mix.domains[0]
        tie = hashlib.md5((text or "").encode()).hexdigest()
        leaves[domain, lang or "", source or ""].append((i, n, tie))
    cap = {k: mix.max_epochs * sum(n for _, n, _ in v) for k, v in leaves.items()}
    budget = sum(cap.values()) // mix.max_epochs * mix.percent // 100
    tables = (mix.domain_weights, mix.language_weights, mix.source_weights)
    cap = {k: c if all(t.get(n, mix.other) for t, n in zip(tables, k, strict=True)) else 0 for k, c in cap.items()}
    weight = [lambda k: mix.domain_weights.get(k, mix.other), lambda k: mix.language_weights.get(k, mix.other),
              lambda k: mix.source_weights.get(k, mix.other)]

    def fill(prefix, budget):
        depth = len(prefix)
        if depth == 3:
            return {prefix: budget}
        kids = Counter()
        for k, c in cap.items():
            if k[:depth] == prefix:
                kids[k[:depth + 1]] += c
        shares = water_fill(budget, {k: (weight[depth](k[-1]), c) for k, c in kids.items()})
        out = {}
        for k, b in shares.items():
            out |= fill(k, b)
        return out

    chosen = Counter()
    for leaf, share in fill((), budget).items():
        docs, epoch = leaves[leaf], 0
        total = sum(n for _, n, _ in docs)
        while total and share >= total:
            chosen.update((i, epoch) for i, n, _ in docs if n)
            share, epoch = share - total, epoch + 1
        used = 0
        key = lambda d: hashlib.md5(f"{mix.seed}:{epoch}:{'' if d[0] is None else d[0]}".encode()).hexdigest() + d[2]  # noqa: E731, B023
        for i, n, _ in sorted((d for d in docs if d[1]), key=key):
            used += n
            if used > share:
                break
            chosen[i, epoch] += 1
    return chosen


def corpus():
    rows = []
    for i in range(400):
        lang = ["en", "en", "en", "de", "fr", None][i % 6]
        source = "src0" if i % 3 == 0 else ["src1", "src2", "src13", "plain", None][i % 5]
        rows.append((i, "w " * (1 + i * 37 % 50), lang, source))
    return rows + [(500, None, "en", "src1"), (501, "", "en", "src1"), (502, "  ", "es", "src4")]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    for mix in (Mix(), Mix(percent=150), Mix(percent=95, domain_weights={"books": 50, "code": 0}),
                Mix(percent=20, source_weights={"src0": 9, "src2": 0}, seed="other"), Mix(percent=0)):
        got = Counter((r.doc_id, r.epoch) for r in mixing.mix_sources(df, mix).selectExpr(
            "row.doc_id", "epoch").collect())
        assert got == brute(rows, mix), mix


def test_shortage_goes_to_siblings_first(spark):
    """src1 is short: its share goes to src4 of the same language, not to the other domain."""
    rows = [(i, "w " * 10, "en", "src4") for i in range(100)] + [(200, "w " * 10, "en", "src1")]
    rows += [(i, "w " * 10, "en", "src2") for i in range(300, 500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    mix = Mix(percent=40, max_epochs=1, domain_weights={"books": 1, "code": 1})
    got = Counter(r.source for r in mixing.mix_sources(df, mix).select("source").collect())
    assert got == {"src1": 1, "src4": 59, "src2": 60}


def test_awkward_rows(awkward, no_docs):
    out = mixing.mix_sources(awkward, Mix(percent=200))
    assert out.select("row.*").columns == awkward.columns
    texts = [r.text for r in out.select("row.text").collect()]
    assert all(t and t.split() for t in texts) and len(texts) > 5
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in awkward.collect()]
    for percent in (30, 50, 70, 120):
        mix = Mix(percent=percent)
        got = Counter((r.doc_id, r.epoch) for r in mixing.mix_sources(awkward, mix).selectExpr(
            "row.doc_id", "epoch").collect())
        assert got == brute(rows, mix), percent
    assert mixing.mix_sources(no_docs).count() == 0


def test_rows_without_ids_fill_their_share(spark):
    """No ids, one id for all, and equal rows: the budget is used to the last row that fits."""
    schema = "doc_id bigint, text string, lang string, source string, key string"
    for ids, texts in (([None] * 50, [f"w{i} " * 10 for i in range(50)]), ([7] * 50, [f"w{i} " * 10 for i in range(50)]),
                       ([None] * 50, ["w " * 10] * 50), ([7] * 25 + [None] * 25, ["w " * 10] * 50)):
        rows = [(i, t, "en", "src1") for i, t in zip(ids, texts, strict=True)]
        df = spark.createDataFrame([(*r, str(n)) for n, r in enumerate(rows)], schema)
        for percent, want in ((60, 300), (25, 120), (130, 650)):
            done = mixing.mix_sources(df, Mix(percent=percent))
            assert done.groupBy().sum("tokens").first()[0] == want
            got = Counter((r.doc_id, r.epoch) for r in done.selectExpr("row.doc_id", "epoch").collect())
            assert got == brute(rows, Mix(percent=percent))
