"""Nulls, empty texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import chat_format, decontaminate, exact_dedup, language_id, line_dedup, packing, pii, quality, simhash, substring_dedup

LONG = "word " * 30_000
ROWS = [(1, "A line\nother\n\n", "en"), (1, "A line\nother\n\n", "en"), (2, None, None), (3, "", "en"), (None, "a LINE \nmore", "de"), (4, LONG, "en"), (5, "ünïcode\ta line", None), (6, "A line\nother\n\n", "en")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string")
    # names that results use as well
    return df.withColumns({"n_lines": F.lit("x"), "kept": F.lit("x"), "fingerprint": F.lit("x"), "score": F.lit("x"), "items": F.lit("x"), "spans": F.lit("x"), "component_id": F.lit("x"), "keep_id": F.lit("x")}).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(rows):
    return sorted((str(r.doc_id), tuple(r)) for r in rows)


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_line_dedup(docs, none, broadcast):
    out = line_dedup.line_dedup(docs, min_docs=4, broadcast_hashes=broadcast)
    assert out.columns.count("n_lines") == 1
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in out.collect())
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    texts = [(i, t or "") for i, t, _ in ROWS]
    n = Counter(k for _, t in texts for k in {key(x) for x in t.split("\n")} if k)
    want = []
    for i, t in texts:
        lines = t.split("\n")
        kept = [x for x in lines if n[key(x)] < 4]
        want.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    assert got == sorted(want)
    assert line_dedup.line_dedup(none).count() == 0


def test_exact_dedup(docs, none):
    rows = exact_dedup.exact_dedup(docs).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.text_sha256, []).append(r)
    assert len(rows) == len(ROWS)
    for sha, own in groups.items():
        assert sum(r.kept for r in own) == 1 and {r.group_size for r in own} == {len(own)}
        top = min(own, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        assert {r.keep_id for r in own} == {top.doc_id}
        assert sha == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", own[0].text or "").encode()).hexdigest()
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_in_slices(spark):
    rows = [(k, f"text {k % 700}") for k in range(70_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = exact_dedup.exact_dedup(df, broadcast_blocks=2).agg(F.count(F.when(F.col("kept"), 1)).alias("k"), F.count(F.lit(1)).alias("n"), F.max("keep_id").alias("m"), F.min("group_size").alias("g")).first()
    assert tuple(got) == (700, 70_000, 699, 100)


def plain_fingerprint(text):
    """The contract's fingerprint, bit by bit."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
    own = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in own]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket", [256, 1])
def test_simhash(docs, none, bucket):
    rows = simhash.simhash_near_dedup(docs.withColumn("body", F.col("text")), bucket=bucket).collect()
    own = [(r.doc_id, plain_fingerprint(r.body or "")) for r in rows]
    assert all(r.fingerprint % 2**64 == f for r, (_, f) in zip(rows, own)) and "text" not in rows[0].asDict()
    fps = np.array([f for _, f in own], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    label = list(range(len(rows)))
    for _ in rows:
        label = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(rows))]
    for k, r in enumerate(rows):
        ids = [rows[j].doc_id for j in range(len(rows)) if label[j] == label[k] and rows[j].doc_id is not None]
        assert r.component_id == (min(ids) if ids else None)
    assert simhash.simhash_near_dedup(none).count() == 0


def test_golay_keys_meet():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    bit = lambda: np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
    fps = np.concatenate([base, base ^ bit(), base ^ bit() ^ bit()])
    keys, owner = simhash.golay_keys(fps)
    sets = [set(keys[owner == i].tolist()) for i in range(len(fps))]
    assert all(sets[i] & sets[i + 300] and sets[i] & sets[i + 600] for i in range(300))
    assert len(keys) / len(fps) <= 18
    words = np.arange(1 << 12, dtype=np.uint32) << np.uint32(11)  # every codeword is its own nearest one
    index = simhash.codewords(words)
    assert len(index) == 1 << 12


def brute_windows(texts, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {}
    for k, t in items:
        w = split(t)
        if w:
            n = min(10, len(w))
            for p in range(len(w) - n + 1):
                windows.setdefault(tuple(w[p : p + n]), set()).add(str(k))
    out = []
    for i, t in texts:
        w = split(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[p : p + n]))) is not None:
                    hit |= set(range(p, p + n))
                    found |= own
        out.append((str(i), len(w), len(hit), sorted(found)))
    return sorted(out)


@pytest.mark.parametrize("slice_words", [200_000, 5])
def test_decontamination(spark, docs, none, slice_words):
    items = [(1, " ".join(f"w{k}" for k in range(14))), (2, "more"), (3, None), (4, "..."), (5, "a line other"), (5, "a line other"), (6, " ".join(f"W{k}" for k in range(3, 13)))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    more = spark.createDataFrame([(9, "x " + " ".join(f"w{k}" for k in range(2, 13)) + " y a, LINE: other z", "en"), (10, "w0 w1 w2 " * 9, "en")], "doc_id bigint, text string, lang string")
    every = docs.select("doc_id", "text", "items").unionByName(more.select("doc_id", "text", F.lit("x").alias("items")))
    rows = decontaminate.find_contamination(every, bench, slice_words=slice_words).collect()
    got = sorted((str(r.doc_id), r.n_words, sum(s.end - s.start for s in r.hit_spans), r["items"]) for r in rows)
    assert got == brute_windows([(r.doc_id, r.text) for r in rows], items)
    clean = {r.doc_id: r.text for r in decontaminate.decontaminate(more, bench, max_coverage=0.9, slice_words=slice_words).collect()}
    assert clean[9] == "x  y  z" and clean[10] == "w0 w1 w2 " * 9
    assert decontaminate.find_contamination(none, bench).count() == 0
    assert {r.n_words for r in decontaminate.find_contamination(more, bench.limit(0)).collect()} == {17, 27}


def test_decontamination_coverage_counts_capitals(spark):
    hit = " ".join(f"w{k}" for k in range(10))
    bench = spark.createDataFrame([(1, hit)], "item_id bigint, text string")
    rows = [(1, "AB " * 45 + hit), (2, hit.upper()), (3, "AB " * 8 + hit), (4, "AB " * 45)]
    clean = {r.doc_id: r.text for r in decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert clean == {1: "AB " * 45, 4: "AB " * 45}


@pytest.mark.parametrize("passage", [None, 24])
@pytest.mark.parametrize("classes", [256, 1])
def test_substring_dedup(docs, none, classes, passage):
    df = docs.unionByName(docs.sparkSession.createDataFrame([(20, "xx" + "abcdefghij" * 4 + "q", ""), (21, "y" + "abcdefghij" * 4 + "zz", ""), (22, "p" + "abcdefghij" * 3 + "abcdefghi", "")], "doc_id bigint, text string, lang string"), allowMissingColumns=True)
    rows = substring_dedup.substring_dedup(df, length=40, q=10, classes=classes, passage=passage, passage_q=8).collect()
    texts = [(r.text or "").encode() for r in rows]
    n = {k: Counter(t[i : i + k] for t in texts for i in range(len(t) - k + 1)) for k in (24, 40)}

    def covered(t, k):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - k + 1):
            if n[k][t[i : i + k]] > 1:
                gone[i : i + k] = True
        return gone

    for r, t in zip(rows, texts):
        gone = covered(t, 40)
        assert passage is None or r.n_passage_bytes == covered(t, 24).sum()
        assert (r.n_bytes, r.n_removed, bytes(r.kept)) == (len(t), int(gone.sum()), np.frombuffer(t, np.uint8)[~gone].tobytes())
    assert substring_dedup.substring_dedup(none).count() == 0


@pytest.mark.parametrize("collide", [False, True])
def test_refinement(monkeypatch, collide):
    """Repeated windows of any length, against counting; grams of one hash are told apart by their bytes."""
    if collide:
        real = substring_dedup.gram_hashes
        monkeypatch.setattr(substring_dedup, "gram_hashes", lambda data, q: real(data, q) & np.uint64(1))
    rng = np.random.default_rng(5)
    for length in [*range(1, 40), 256, 400]:
        base = rng.integers(97, 97 + int(rng.integers(1, 4)), 900).astype(np.uint8).tobytes()
        contexts = [base[s : s + length + int(rng.integers(0, 60))] for s in rng.integers(0, 400, 6).tolist()]
        n = Counter(c[i : i + length] for c in contexts for i in range(len(c) - length + 1))
        want = [[i for i in range(len(c) - length + 1) if n[c[i : i + length]] > 1] for c in contexts]
        assert [x.tolist() for x in substring_dedup.repeated_windows(contexts, length)] == want


def test_packing(docs, none):
    path = packing.default_tokenizer()
    rows = packing.pack(docs, path, capacity=64, with_ids=True).collect()
    tokenizer = packing.encoder(path).tokenizer
    want = Counter()
    for i, t, _ in ROWS:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, (s, n) in enumerate(packing.cut_points(len(ids), 64)):
            part = np.array(ids[s : s + n], "<u4").tobytes()
            want[str(i), k, s, n, zlib.crc32(part), part] += 1
    assert Counter((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in rows) == want
    for own in _sequences(rows).values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    packed = packing.sequences(packing.pack(docs, path, capacity=64, with_ids=True))
    assert packed.agg(F.sum(F.length("ids"))).first()[0] == 4 * sum(r.length for r in rows)
    assert packing.pack(none, path).count() == 0


def _sequences(rows):
    out = {}
    for r in rows:
        out.setdefault(r.sequence_id, []).append(r)
    return out


def test_plan_is_tight():
    rng = np.random.default_rng(2)
    histogram = dict(Counter(rng.integers(1, 2048, 5000).tolist()))
    patterns = packing.plan(histogram)
    used = Counter()
    for pattern, times in patterns:
        assert sum(pattern) <= 2048
        for x in pattern:
            used[x] += times
    assert used == Counter(histogram)
    bins, total = sum(t for _, t in patterns), sum(k * v for k, v in histogram.items())
    assert bins <= -(-total // 2048) * 1.01 + 1


def test_pii(docs, none):
    rows = pii.find_pii(docs.unionByName(docs.sparkSession.createDataFrame([(30, "é a.b+c@x-y.co.uk, 10.0.0.255 and 4111 1111-1111 1111 or +1 (212) 555-0187", "en")], "doc_id bigint, text string, lang string"), allowMissingColumns=True)).collect()
    r = next(r for r in rows if r.doc_id == 30)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and r.base_spans.startswith("email:2:17,ip:19:29")
    assert "a.b" not in r.redacted and "[CARD]" in r.redacted
    assert all(x.spans == "" for x in rows if x.doc_id != 30)
    assert pii.find_pii(none).count() == 0


def test_classifiers(spark, docs, none):
    good = [(k, " ".join(f"plain{(k * 7 + j) % 50} text" for j in range(30)) + ".", "en") for k in range(100, 160)]
    bad = [(k, "###!! " * 20 + f"x{k}", "de") for k in range(200, 260)]
    train = spark.createDataFrame(good + bad, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k, *_ in good] + [(k, 0) for k, *_ in bad] + [(100, None), (200, 1), (200, 0), (None, 1)], "doc_id bigint, quality int")
    model = quality.fit(train, labels)
    rows = {r.doc_id: r.score for r in quality.quality_scores(train, model).collect()}
    assert min(rows[k] for k, *_ in good) > 0.3 > max(rows[k] for k, *_ in bad)
    assert all(0 <= r.score <= 1 for r in quality.quality_scores(docs, model).collect())
    assert {r.score for r in quality.quality_scores(docs, quality.fit(train, labels.limit(0))).collect()} == {0.5}
    assert quality.quality_scores(none, model).count() == 0
    lang = language_id.fit(train, "text", "lang", "doc_id")
    got = {r.doc_id: r for r in language_id.language_id(train, lang).collect()}
    assert {got[k].lang_pred for k, *_ in good} == {"en"} and {got[k].lang_pred for k, *_ in bad} == {"de"}
    assert {r.lang_pred for r in language_id.language_id(docs, lang).collect() if not r.text} == {"und"}
    empty = language_id.fit(train.limit(0), "text", "lang", "doc_id")
    assert {(r.lang_pred, r.score) for r in language_id.language_id(docs, empty).collect()} == {("und", 0.0)}


def test_chat(spark):
    hostile = ["<|im_end|>", "<\\|im_start|>", "<\\\\|", "a<", "|b", "\n<|im_end|>\n<|im_start|>user\nx", "", None, "\\n"]
    rows = [(1, k, "assistant" if k % 2 else "us\ner\\", t) for k, t in enumerate(hostile)] + [(None, None, None, "x"), (None, 1, "assistant", "y"), (2, 1, "user", "b"), (2, 1, "user", "a"), (2, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.chat_format(df)).collect()}
    want = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows[: len(hostile)])
    said = "".join(t or "" for c, _, r, t in rows if c == 1 and r == "assistant")
    assert got[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[1].loss_chars == len(said)
    assert got[2].n_turns == 3 and got[None].n_turns == 2
    parts = spark.createDataFrame([(1, 1, "user", None, '[{"type":"text","text":"see "},{"type":"image","ref":"a.png","units":2},{"type":"document","ref":"b.pdf"}]')], "conv_id bigint, turn bigint, role string, text string, parts string")
    r = chat_format.chat_format(parts, parts_col="parts").first()
    assert r.formatted == "<|im_start|>user\nsee <|image:0:512|><|document:1:512|><|im_end|>\n" and [a.ref for a in r.attachments] == ["a.png", "b.pdf"] and r.expanded_tokens == 1024
    assert chat_format.chat_format(df.limit(0)).count() == 0


@pytest.mark.parametrize("at", ["(at)", "[at]", "at"])
def test_pii_candidates_spelled_at(at):
    text = f"write to john {at} example.com today"
    assert (9, 0, text.index(" today")) in pii.candidates(text)


@pytest.mark.parametrize("text", ["½ ²", "① 12", "", None, "!!", "\u0903", "٣"])
def test_language_needs_a_letter(text):
    names, matrix, prior = ["en"], np.zeros((1 << language_id.BITS, 1), np.float32), np.zeros(1)
    assert language_id.score_batch([text, "ab", "日"], matrix, prior, names) == (["und", "en", "en"], [0.0, 1.0, 1.0])


def test_language_scores_are_sums():
    rng = np.random.default_rng(8)
    matrix, prior, names = rng.normal(size=(1 << language_id.BITS, 3)).astype(np.float32), rng.normal(size=3), ["a", "b", "c"]
    batch = ["one two", "Δ five", "x" * 300_000, "one two"]
    pred, score = language_id.score_batch(batch, matrix, prior, names)
    for k, t in enumerate(batch):
        total = prior + sum(matrix[language_id.slots(t, n)].sum(axis=0, dtype=float) for n in language_id.GRAMS)
        p = np.exp(total - total.max())
        assert pred[k] == names[p.argmax()] and abs(score[k] - p.max() / p.sum()) < 1e-9
    assert score[0] == score[3]


def test_decontamination_cuts_again_in_slices(spark):
    items = [(1, " ".join(f"a{k}" for k in range(10))), (2, " ".join(f"b{k}" for k in range(10)))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    text = "x " + " ".join(f"a{k}" for k in range(5)) + " " + items[1][1] + " " + " ".join(f"a{k}" for k in range(5, 10)) + " y" * 60
    docs = spark.createDataFrame([(1, text, 3), (2, None, 4), (1, text, 3), (3, "clean", 5)], "doc_id bigint, text string, __words int").withColumnRenamed("__words", "other")
    got = [decontaminate.decontaminate(docs, bench, slice_words=n).orderBy("doc_id").collect() for n in (5, 1000)]
    assert got[0] == got[1] and [r.doc_id for r in got[0]] == [1, 1, 2, 3] and got[0][0].text.split() == ["x", *["y"] * 60]


def plain_base(text):
    """The contract's base spans by its regular expressions."""
    digits = lambda m: re.sub("[^0-9]", "", m)
    octets = lambda m: all(int(x) <= 255 for x in m.split("."))
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", octets),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (pattern, ok) in enumerate(kinds) for m in re.finditer(pattern, text) if ok(m[0]))


def test_pii_base_against_plain_patterns():
    rng = np.random.default_rng(12)
    parts = ["4111 1111 1111 1111", "+1 (212) 555-0187", "10.0.0.1", "a.b@c.de", "@", ".", "+", "-", " ", "é", "1", "256.1.1.1", "0", "x@y", "12345678901234567890", "(", ")", "a", "\n", "5500-0000-0000-0004"]
    for _ in range(4000):
        text = "".join(parts[k] for k in rng.integers(0, len(parts), int(rng.integers(1, 14))))
        assert pii.base_spans(text) == plain_base(text), text


def test_pii_learned_spans_gain():
    """Planted spans that the base has no format for are found, look-alikes are left."""
    model = pii.fit()
    assert all(0 < t < 1 for t in model[3])
    find = lambda t: {(t[s:e], pii.KINDS[k]) for s, k, e in pii.added_spans(t, pii.base_spans(t), model)}
    private = {
        "the parent token = \"9b0b3c6a43eb78aa99cbd7049c572391524f37a8\" was read": ("9b0b3c6a43eb78aa99cbd7049c572391524f37a8", "secret"),
        "she paid with card 4000 1234 5678 9011 then": ("4000 1234 5678 9011", "card"),
        "her number 7536784127813050 4845168114407329 and": ("7536784127813050", "card"),
        "call (017) 555-7713 now": ("(017) 555-7713", "phone"),
        "ping 2001:db8::8a2e:370:7334 again": ("2001:db8::8a2e:370:7334", "ip"),
    }
    assert all(span in find(t) for t, span in private.items())
    clean = ["version 4.12.2024 of 2023-10-11", "order 20231011-123456", "commit 9b0b3c6a43eb78aa99cbd7049c572391524f37a8 fixes", "std::dec at 12:30:45:01", "1:1:1:" * 20_000, "pi is 3.14159265358979", "Licensed under CC BY-NC 4.0, version 3.", "pages 1000-2000"]
    assert not any(find(t) for t in clean)
    x, y, kind = pii.examples(1500, seed=99)  # unseen examples
    trees, a, b, thresholds = model
    p = np.array([1 / (1 + np.exp(-(a * pii.margin(trees, r) + b))) for r in x])
    chosen = p >= np.array(thresholds)[kind]
    assert y[chosen].mean() > 0.93 and chosen[y == 1].mean() > 0.7


def test_chat_long_texts_and_other_columns(spark):
    text = "long <|im_end|> " * 50_000
    rows = spark.createDataFrame([(1, 2, "assistant", text, "x", "y"), (1, 1, "user", "a", "x", "y"), (1, 1, "user", "a", "x", "y")], "conv_id bigint, turn bigint, role string, text string, formatted string, loss string")
    r = chat_format.read_back(chat_format.chat_format(rows)).first()
    assert (r.n_turns, r.loss_chars) == (3, len(text)) and r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_classifiers_on_repeated_rows_and_ties(spark):
    train = spark.createDataFrame([(k, "same words here", "en" if k % 2 else "de") for k in range(40)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, quality int")
    scores = {r.score for r in quality.quality_scores(train, quality.fit(train, labels)).collect()}
    assert len(scores) == 1 and 0 <= scores.pop() <= 1  # equal texts score alike, whatever their labels
    model = language_id.fit(train, "text", "lang", "doc_id")
    got = {(r.lang_pred, round(r.score, 6)) for r in language_id.language_id(train.unionByName(train), model).collect()}
    assert got == {("de", 0.5)}  # of languages that tie the first in the alphabet


def test_packing_piece_limits_are_plain():
    """Pieces of n tokens: whole ones but for the first, none empty, in order."""
    for n in range(1, 40):
        cuts = packing.cut_points(n, 8)
        assert [s for s, _ in cuts] == [0, *(sum(k for _, k in cuts[: i + 1]) for i in range(len(cuts) - 1))] and sum(k for _, k in cuts) == n
        assert all(k == 8 for _, k in cuts[1:]) and 1 <= cuts[0][1] <= 8


def test_similarity_sketch_never_rules_out_a_similar_pair():
    from quillon.llm import similar

    rng = np.random.default_rng(13)
    fresh = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    for _ in range(300):
        both = fresh(int(rng.integers(1, 900)))
        own = int(len(both) * 0.25)
        x = int(rng.integers(0, own + 1))
        a, b = (np.unique(np.concatenate([both, fresh(k)])) for k in (x, own - x))
        if similar.jaccard(a, b) >= 0.8:
            room = len(a) + len(b) - 2 * int(np.ceil((len(a) + len(b)) * 0.8 / 1.8 - 1e-6))
            for size in (256, 1024):
                different = np.bitwise_count((similar.parities(a, size) ^ similar.parities(b, size)).view(np.uint64)).sum()
                assert different <= room
