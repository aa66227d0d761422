"""Every operator against a brute-force version on small documents, and its defined results on odd input."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle_check import duck_rows, spark_rows
from pyspark.sql import functions as F

from tagloom.llm import langid, licenses, lm, mixing, neardup, packing, pii, quality, sequences, topk
from tagloom.llm.queries import oracle_sql, queries, tokenizer_file

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "word " * 30_000
ODD = [None, "", " \n\t ", "one", "Éa ñ\x0bß\x0c1 \x85x", "a b c d e", "a b c d e", LONG, "x" * 70_000, "😀 <|endoftext|>  two\n\n three "]


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def words(text):
    return WORD.findall(text or "")


def clashing(docs):
    """The documents with further columns of names that the operators use themselves."""
    names = ("spans", "base", "text_", "key", "score", "lang_pred", "id", "n", "words", "bucket", "row", "__0", "failed")
    return docs.withColumns({n: F.lit(1) for n in names})


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    assert spark_rows(queries()[name](spark, FOLDER)) == duck_rows(FOLDER, oracle_sql()[name])


# packing


def padding(hist, ends):
    return sum(c * (min(e for e in ends if e >= n) - n) for n, c in hist)


def test_boundaries_are_optimal():
    import itertools

    rng = random.Random(3)
    for _ in range(60):
        hist = [(n, rng.randint(1, 9)) for n in rng.sample(range(1, 40), rng.randint(1, 8))]
        k = rng.randint(1, 4)
        lengths = sorted(n for n, _ in hist)
        found = packing.boundaries(hist, k)
        best = min(
            padding(hist, [*some, lengths[-1]])
            for r in range(min(k, len(lengths)))
            for some in itertools.combinations(lengths[:-1], r)
        )
        assert padding(hist, found) == best and len(found) == min(k, len(lengths))
    assert packing.boundaries([], 3) == []


def test_packing_places_every_token_once(spark, make_docs):
    docs = clashing(make_docs([*ODD, (None, "no id"), (3, "one")]))
    rows = packing.pack(packing.word_lengths(docs), max_len=1000, buckets=3, budget=2500).collect()
    want = Counter()
    for k, text in [*enumerate(ODD), (None, "no id"), (3, "one")]:
        want[k] += len(words(text)) + 1
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
        assert r.length <= r.bucket_len and r.slot < max(1, 2500 // r.bucket_len)
    assert got == want
    places = Counter((r.bucket_len, r.batch, r.slot) for r in rows)
    assert set(places.values()) == {1}
    assert packing.pack(packing.word_lengths(make_docs([]))).collect() == []
    assert packing.pack(spark.createDataFrame([(1, None), (2, 0)], "doc_id long, length int")).collect() == []


# personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m.group() if c.isdigit()]
        luhn = sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and luhn % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m.group())) <= 15]
    return [(s, pii.KINDS[k], e) for s, k, e in sorted(out)]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(5)
    bits = ["a@b.c", "@", ".", "..", "x", "+", "+1 (", ") 555-1234567", "1.2.3.4", "256", "4337166598464399", " ", "-", "0", "12",
            "é", "\n", "٣", "_", "%", "4111 1111 1111 1111", "(", ")"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(text)[0] == brute_spans(text), text


def test_personal_data_adds_credentials_and_masks(spark, make_docs):
    rng = random.Random(1)
    token = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [f"the key password={token(18)} is here {k}" for k in range(30)]
    texts += [f'set token = "{token(40)}" now' for _ in range(30)]
    texts += [f"plain words of page {k} and version {k}.{k}" for k in range(60)] + ["mail me@x.org or +1 (743) 555-3824"]
    docs = clashing(make_docs([*texts, *ODD]))
    model = pii.fit(docs)
    rows = {r.doc_id: r for r in pii.annotate(docs, model).collect()}
    for k, text in enumerate(texts):
        kinds = [s.kind for s in rows[k].spans]
        want = ["secret"] if k < 60 else ["email", "phone"] if k == 120 else []
        assert kinds == want, text
        assert [(s.start, s.kind, s.end) for s in rows[k].base] == brute_spans(text)
    out = {r.doc_id: r.text for r in pii.masked(docs, model).collect()}
    assert out[120] == "mail <EMAIL> or <PHONE>" and re.search(r"[0-9a-f]{18}", out[0]) is None
    assert [out[len(texts) + k] for k in range(len(ODD))] == ODD
    empty = make_docs([])
    assert pii.annotate(empty, pii.fit(empty)).collect() == []


def test_numbers_beside_numbers_and_named_values_are_found(spark, make_docs):
    found = {
        "SSN 123-45-6789 555-123-4567": [("id", "123-45-6789"), ("tel", "555-123-4567")],
        "Call 555-123-4567. 2024 was": [("tel", "555-123-4567")],
        "555-123-4567 192.168.0.1": [("tel", "555-123-4567"), ("ip", "192.168.0.1")],
        "ssn 123456789": [("id", "123456789")],
        "call 4155550123 4155550199 4155550200 now": [("tel", n) for n in ("4155550123", "4155550199", "4155550200")],
        "phone 415.555.0123": [("tel", "415.555.0123")],
        "password: hunter2": [("secret", "hunter2")],
        "password: letmein": [("secret", "letmein")],
        "the token of page 12 and 3.4": [],
    }
    found |= {f"contact {k} of them": [] for k in range(40)}
    docs = make_docs(list(found))
    model = pii.fit(docs)
    masked = {r.doc_id: r.text for r in pii.masked(docs, model).collect()}
    for r in pii.annotate(docs, model).collect():
        text, want = list(found.items())[r.doc_id]
        assert [(s.kind, text[s.start : s.end]) for s in r.spans] == want, text
        assert not any(value in masked[r.doc_id] for _, value in want)


# language identification


def test_forward_sums_all_segmentations():
    keys = langid.pieces(tokenizer_file(langid.VOCABULARY))
    every = langid.piece_bytes(keys)
    known = {p: i for i, p in enumerate(every)}
    assert len(known) == len(every) and max(map(len, every)) > 20  # no piece is too long
    rng = np.random.default_rng(0)
    p = rng.random((len(known), 2))
    p /= p.sum(0)

    def total(word, lang):
        # sums[i]: all segmentations of the first i bytes
        sums = [1.0]
        for end in range(1, len(word) + 1):
            sums.append(sum(sums[i] * p[known[word[i:end]], lang] for i in range(max(0, end - 40), end) if word[i:end] in known))
        return sums[-1]

    longest = sorted(every, key=len)[-3:]
    cases = [b" the", b" a", b" \xc3\xa9t\xc3\xa9", b" keitung", "すべての日本語の文".encode(), *longest, b" x".join(longest), b"ab" + longest[0] + longest[1]]
    logs = langid.Lattice(cases, keys).forward(p)
    for k, word in enumerate(cases):
        for lang in range(2):
            assert math.isclose(logs[k, lang], math.log(total(word, lang)), rel_tol=1e-9)
    # Expected uses add up to the bytes of the words, each covered once, also where probabilities leave the range of doubles.
    cases += [b" " + "漢字かな".encode() * 100, b" " + b"internationalization" * 60]
    sizes = np.array([len(x) for x in every])
    weight = np.arange(1.0, len(cases) + 1)
    uses = langid.Lattice(cases, keys).expected(p[:, 0], weight)
    assert math.isclose((uses * sizes).sum(), sum(len(w) * (k + 1) for k, w in enumerate(cases)))
    # Uses by their definition, over all segmentations.
    def cuts(word):
        return [[]] if not word else [[word[:n], *c] for n in range(1, len(word) + 1) if word[:n] in known for c in cuts(word[n:])]

    word = b" there"
    chance = [(math.prod(p[known[x], 0] for x in c), Counter(c)) for c in cuts(word)]
    whole = sum(x for x, _ in chance)
    uses = langid.Lattice([word], keys).expected(p[:, 0], np.ones(1))
    want = {x: sum(q * c[x] for q, c in chance) / whole for x in set().union(*(c for _, c in chance))}
    assert len(want) > 9 and all(math.isclose(uses[known[x]], n, rel_tol=1e-9) for x, n in want.items())


def test_lattices_in_blocks_hold_every_word():
    words = [b"x" * n for n in (5, 900, 1, 1, 1, 300, 2000, 7)]
    parts = list(langid.blocks(words, 310))
    assert [w for part in parts for w in words[part]] == words and list(langid.blocks([], 3)) == []
    assert all(sum(map(len, words[part])) <= 310 or part.stop - part.start == 1 for part in parts)


def test_texts_without_blanks_are_told_apart(spark, make_docs):
    """Chinese and Japanese clauses of far more bytes than any usual word."""
    rng = random.Random(21)
    chinese = ["我们今天去学校学习", "这个问题很重要但是没有人回答", "中国的经济发展得非常快", "他说他不知道这件事情的原因"]
    japanese = ["私たちは今日学校に行きました", "この問題はとても重要ですが誰も答えません", "日本の経済はとても早く発展した", "彼は理由を知らないと言っています"]
    make = lambda pool: "".join(rng.choice(pool) for _ in range(8))
    train = make_docs([make(chinese) for _ in range(30)], "zh").union(make_docs([make(japanese) for _ in range(30)], "ja"))
    vocabulary = tokenizer_file(langid.VOCABULARY)
    model = langid.fit(train, vocabulary)
    texts = [make(chinese) for _ in range(20)] + [make(japanese) for _ in range(20)]
    rows = {r.doc_id: r for r in langid.predict(make_docs(texts), model, vocabulary).collect()}
    assert [rows[k].lang_pred for k in range(40)] == ["zh"] * 20 + ["ja"] * 20 and min(r.score for r in rows.values()) > 0.9


def test_dirty_labels_are_bounded(spark, make_docs, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    train = make_docs(["the cat and the dog"] * 5, "en").union(make_docs(["le chat et la maison"] * 5, "fr"))
    for k in range(4):
        train = train.union(make_docs(["noise"], f"x{k}"))
    assert langid.fit(train, tokenizer_file(langid.VOCABULARY)).langs == ("en", "fr")


def test_language_of_held_out_documents(spark):
    rows = queries()["op3_language"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    known = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert sum(known[r.doc_id] == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark, make_docs):
    vocabulary = tokenizer_file(langid.VOCABULARY)
    train = make_docs(["the cat and the dog"] * 5, "en").union(make_docs(["le chat et la maison"] * 5, "fr"))
    model = langid.fit(train.union(make_docs([None, "x"], None)), vocabulary)
    rows = langid.predict(clashing(make_docs([*ODD, "12 34 !", "la maison", "the dog"])), model, vocabulary).collect()
    found = {r.doc_id: r.lang_pred for r in rows}
    n = len(ODD)
    assert [found[k] for k in (0, 1, 2, n, n + 1, n + 2)] == ["und", "und", "und", "und", "fr", "en"]
    none = langid.fit(make_docs([]), vocabulary)
    assert {(r.lang_pred, r.score) for r in langid.predict(make_docs(["the"]), none, vocabulary).collect()} == {("und", 0.0)}


# top-k


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = [[float(x) for x in rng.normal(size=12)] for _ in range(300)]
    vectors += [vectors[0]] * 40 + [[1e12] * 12, [-1e12] * 12, [], [0.5] * 3, None, [float("nan")] * 12, [1.0, None]]
    # Components whose squares leave the range of doubles; with them bounds are no numbers.
    vectors += [[1e200] * 12, [-1e200, 1.0] * 6, [1e200] + [0.0] * 11, [1e160] * 12, [1e-300] * 12]
    rows = [*enumerate(vectors), (None, vectors[1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).repartition(4)
    found = topk.top_k(df.where("vec_id % 50 = 0 or vec_id >= 340"), df, block=3).collect()
    ints = {}
    for k, v in rows:
        if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints[k] = [math.floor(256 * x) for x in v] + [0] * (12 - len(v))
    want = set()
    for q in ints:
        if q % 50 == 0 or q >= 340:
            cut = lambda s: min(max(s, -(2**63)), 2**63 - 1)
            scored = [(-cut(sum(a * b for a, b in zip(ints[q], v))), k) for k, v in ints.items() if k != q]
            for rank, (s, k) in enumerate(sorted(scored)[:5], 1):
                want.add((q, rank, k, -s))
    assert {tuple(r) for r in found} == want
    few = spark.createDataFrame([(50, [1.0]), (50, [2.0]), (1, [1.0])], df.drop("id").schema)
    assert sorted(tuple(r) for r in topk.top_k(few.where("vec_id = 50"), few).collect()) == [(50, 1, 1, 65536)]
    assert topk.top_k(few.limit(0), few.limit(0)).collect() == []


def test_bounds_rule_out_pairs_level_by_level(spark):
    rng = np.random.default_rng(8)
    # Vectors of very different means: most pairs go at the first level. Without structure the bounds decide little.
    apart = [(k, (rng.normal(size=64) + (k % 40)).tolist()) for k in range(1500)]
    alike = [(k, rng.normal(size=64).tolist()) for k in range(1500)]
    for rows, least in ((apart, 0.7), (alike, 0.0)):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
        shares = topk.ruled_out(df.where("vec_id % 50 = 0"), df)
        assert shares.keys() == set(topk.LEVELS) and least <= sum(shares.values()) <= 1
        ints = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
        found = {(r.query_id, r.rank): (r.row_id, r.score) for r in topk.top_k(df.where("vec_id % 50 = 0"), df).collect()}
        for q in range(0, 1500, 50):
            score = ints @ ints[q]
            order = [k for k in np.lexsort((np.arange(1500), -score)) if k != q][:5]
            assert [found[q, r] for r in range(1, 6)] == [(k, score[k]) for k in order]
    assert topk.ruled_out(df.limit(0), df) == dict.fromkeys(topk.LEVELS, 0.0)


# personal data in long tokens


def test_long_tokens_take_linear_time():
    import hashlib
    import time

    hexes = [hashlib.md5(str(k).encode()).hexdigest() for k in range(4000)]
    for joint in (".", "=", "/"):
        text = joint.join(hexes)
        began = time.process_time()
        spans, runs = pii.base_spans(text)
        found = pii.candidates(text, spans, runs)
        assert len(found) >= 1 and time.process_time() - began < 4
    numbers = {f for c in pii.candidates("call 5551234567", *pii.base_spans("call 5551234567")) for f in c.features}
    assert numbers
    many = "call " + "1" * 5000
    assert {f for c in pii.candidates(many, *pii.base_spans(many)) for f in c.features if f.startswith("digits=")} <= {"digits=20", *(f"digits={k}" for k in range(20))}


def test_masked_keeps_clashing_columns(spark, make_docs):
    docs = make_docs(["write to a.b@example.com now", None]).withColumn("__text", F.lit("mine"))
    rows = pii.masked(docs, pii.fit(docs)).orderBy("doc_id").collect()
    assert [(r["text"], r["__text"]) for r in rows] == [("write to <EMAIL> now", "mine"), (None, "mine")]


# sequence files


def test_sequence_files_round_trip(spark, make_docs, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    texts = [*ODD, "!" * 9, " lead", "trail ", "a  b", "it's we'll  n\n \n x", *(f"doc {k} text" for k in range(50))]
    docs = clashing(make_docs([*texts, (2, "again")]))
    parts = sequences.write_sequences(docs, tokenizer_file("byte_bpe_50k.json"), str(tmp_path), length=64)
    rows = sorted(map(tuple, sequences.read_documents(spark, parts).collect()), key=lambda r: r[1])
    at, got, want = 0, Counter(), Counter()
    for doc_id, start, n, crc in rows:
        assert start == at
        at += n
        got[doc_id, n, crc] += 1
    assert [r[0] for r in rows] == sorted(r[0] for r in rows)
    stream = []
    for doc_id, text in [*enumerate(texts), (2, "again")]:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want[doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        stream += ids
    assert got == want and at == len(stream)
    seen = 0
    for url, tokens in parts:
        reader = sequences.Reader(url)
        ids, mask = reader[len(reader) - 1]
        assert len(ids) == len(mask) == 64 and mask.any()
        assert sum(reader[k][1].sum() for k in range(len(reader))) == tokens
        seen += tokens
        with pytest.raises(IndexError):
            reader[len(reader)]
    assert seen == len(stream)
    assert sequences.read_documents(spark, sequences.write_sequences(make_docs([]), tokenizer_file("byte_bpe_50k.json"))).collect() == []


def test_units_are_encoded_as_in_the_whole_text():
    path = tokenizer_file("byte_bpe_50k.json")
    held = sequences._Units(path)
    assert held.plain and held.added == ["<|endoftext|>"]
    rng = random.Random(9)
    alphabet = ["a", "B", "the", "'s", "'", "'ll", "1", "23", " ", "  ", "\n", "\n\n", "\t", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", ".", ",", "!?",
                "é", "ß", "ª", "º", "µ", "×", "÷", "²", "¼", "½", "\xad", "\xaa", "ǅ", "ɏ", "ſ", "\x00", "\x7f", "_", "<|endoftext|>", "<|"]
    wild = [*alphabet, "😀", "漢字", "ʰ", "Ω", "\u2028", "\u3000", "٣"]
    texts = [*filter(None, ODD), *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25))) for _ in range(4000))]
    texts += ["".join(rng.choice(wild) for _ in range(rng.randint(1, 25))) for _ in range(1000)]
    # Every character that is cut here, in front of, between and behind others.
    texts += [t for c in map(chr, range(0x250)) for t in (f"{c}{c}a {c}1{c} .{c}\n", f" {c}", f"a{c}", f"{c} {c}")]
    for text in texts:
        assert sequences.encode(text, held) == held.whole(text), repr(text)
    assert 50256 in np.frombuffer(sequences.encode("a <|endoftext|> b", held), held.type).tolist()


def test_sequences_of_null_and_repeated_ids(spark, make_docs, tmp_path):
    pairs = [(None, "no id"), (None, None), (4, "one"), (4, "another text"), (4, "one"), (-2, ""), *((7, f"text {k}") for k in range(40))]
    path = tokenizer_file("byte_bpe_50k.json")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = sequences.write_sequences(clashing(make_docs(pairs)), path, str(tmp_path), length=8)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) > 2 and all(url.startswith("file:") for url, _ in parts)  # the rows of id 7 are in several parts
    rows = sorted(map(tuple, sequences.read_documents(spark, parts).collect()), key=lambda r: r[1])
    assert [r[0] for r in rows] == sorted((k for k, _ in pairs), key=lambda k: (k is not None, k or 0))
    assert [r[1] for r in rows] == [sum(r[2] for r in rows[:k]) for k in range(len(rows))]
    held = sequences._Units(path)
    crcs = lambda t: zlib.crc32(np.append(np.frombuffer(held.whole(t or "") if t else b"", held.type), 0).astype("<u4").tobytes())
    assert sorted((str(r[0]), r[3]) for r in rows) == sorted((str(k), crcs(t)) for k, t in pairs)


# near duplicates


def brute_components(texts):
    sets = []
    for t in texts:
        w = words(lower(t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    lead = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and lead[a] != lead[b]:
                low, high = sorted((lead[a], lead[b]))
                lead = [low if x == high else x for x in lead]
    return {(k, len(sets[k]), lead[k], lead[k] == k) for k in range(len(texts))}


@pytest.mark.parametrize("block", [8, neardup.BLOCK])  # a small one has the large components compared in blocks
def test_near_duplicates_equal_brute_force(spark, make_docs, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 900)}" for _ in range(120)]
    texts = [*ODD, "a b", "A B", "a B c"]
    for _ in range(60):  # copies that are linked through the base rather than with each other
        own = base[:]
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = f"v{rng.randint(0, 10**6)}"
        texts.append(" ".join(own))
    chain = [f"c{k}" for k in range(200)]
    texts += [" ".join(chain[k : k + 150]) for k in range(0, 50, 5)]
    texts += [" ".join(f"u{rng.randint(0, 10**6)}" for _ in range(30)) for _ in range(20)]
    texts += [" ".join(base), " ".join(base).upper()]
    for _ in range(12):  # too far from most copies
        own = base[:]
        for _ in range(9):
            own[rng.randrange(len(own))] = f"z{rng.randint(0, 10**6)}"
        texts.append(" ".join(own))
    got = {tuple(r) for r in neardup.near_duplicates(clashing(make_docs(texts))).collect()}
    assert got == brute_components(texts)


def test_near_duplicates_of_odd_tables(spark, make_docs):
    assert neardup.near_duplicates(make_docs([])).collect() == []
    rows = neardup.near_duplicates(make_docs([(None, "a b"), (5, "a b"), (5, "a b"), (None, None), (7, None)])).collect()
    found = Counter((r.doc_id, r.component_id, r.kept) for r in rows)
    assert found == {(None, 5, False): 1, (5, 5, True): 2, (None, None, True): 1, (7, 7, True): 1}


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9):
        errors = []
        for _ in range(60):
            both = rng.integers(0, 2**63, 400).astype(np.uint64)
            cut = int(400 * (1 - share) / (1 + share) + 0.5)
            a, b = both[: 400 - cut], both[cut:]
            s = neardup.signatures(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 160)
            errors.append((s[0] == s[1]).mean() - len(set(a) & set(b)) / len(set(a) | set(b)))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < math.sqrt(share * (1 - share) / 160) * 1.15
    one = neardup.signatures(np.array([9], np.uint64), np.array([0]), 1, 160)
    assert sorted(v >> 32 for v in one[0].tolist()) == list(range(160))


# language model


def brute_scores(texts, train):
    tokens = Counter()
    for text, learn in zip(texts, train):
        if learn:
            tokens.update([*words(lower(text or "")), None])
    n, v = sum(tokens.values()), len(tokens)
    for text in texts:
        own = [*words(lower(text or "")), None]
        yield len(own), sum(tokens[t] > 0 for t in own), n, sum(math.log10((tokens[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)


def test_language_model(spark, make_docs, monkeypatch):
    monkeypatch.setattr(lm, "HELD", 40)  # so that many words, states and next tokens go through the joins
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    texts = [r.text for r in docs.collect()]
    real = len(texts)
    texts += ODD
    train = [zlib.crc32(str(k).encode()) % 10 != 0 for k in range(len(texts))]
    rows = {r.doc_id: r for r in lm.score(clashing(make_docs(texts)), F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) != 0).collect()}
    held = [0.0, 0.0]
    for k, (n, known, total, base) in enumerate(brute_scores(texts, train)):
        r = rows[k]
        assert (r.train, r.n_tokens, r.n_known, r.train_tokens) == (train[k], n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        if not train[k] and k < real:
            held = [held[0] + r.base_score, held[1] + r.score]
    assert held[1] > held[0]  # the tree predicts unseen texts better than single tokens do
    alone = lm.score(make_docs(["a b", None]), F.lit(None).cast("boolean")).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in alone} == {(0, 0, 0.0, 0.0)}
    assert lm.score(make_docs([]), F.lit(True)).collect() == []


@pytest.mark.parametrize("held", [1 << 20, 6, 0])
def test_tree_follows_its_definition(spark, make_docs, monkeypatch, held):
    monkeypatch.setattr(lm, "HELD", held)
    monkeypatch.setattr(lm, "EVIDENCE", 8)
    monkeypatch.setattr(lm, "LEAST", 2)
    monkeypatch.setattr(lm, "GAIN", 1.0)
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the cat sat", "a dog ran", "the dog", "sat"]) for _ in range(rng.randint(1, 9))) for _ in range(80)]
    texts += [None, "", "only once here"]
    rows = {r.doc_id: r.score for r in lm.score(make_docs(texts), F.lit(True)).collect()}
    streams = [["<", *words(t), ">"] for t in texts]
    total = sum(len(s) - 1 for s in streams)
    counts, following = Counter(), {}
    for s in streams:
        for i in range(1, len(s)):
            for d in range(min(i, lm.DEPTH) + 1):
                counts[tuple(s[i - d : i])] += 1
                following.setdefault(tuple(s[i - d : i]), Counter())[s[i]] += 1
    distinct = len(following[()])
    root = lambda w: (following[()][w] + 0.1) / (total + 0.1 * (distinct + 1))
    frequent = {c for c in counts if c and counts[c] >= lm.EVIDENCE}
    kept = {c: {w: n for w, n in following[c].items() if n >= lm.LEAST} for c in frequent}

    def p(c, w):
        while c and c not in frequent:
            c = c[1:]
        if not c:
            return root(w)
        own = kept[c]
        if w in own:
            return (own[w] - lm.DISCOUNT) / counts[c]
        return left(c) * p(c[1:], w)

    def left(c):
        own = kept[c]
        return (1 - sum((n - lm.DISCOUNT) / counts[c] for n in own.values())) / (1 - sum(p(c[1:], w) for w in own))

    def gain(c):
        own = kept[c]
        saved = sum(n * math.log2((n - lm.DISCOUNT) / counts[c] / p(c[1:], w)) for w, n in own.items())
        return saved + (counts[c] - sum(own.values())) * math.log2(left(c))

    states = {c for c in frequent if gain(c) >= lm.GAIN}
    states |= {c[k:] for c in states for k in range(1, len(c))}
    assert 5 < len(states)
    found = frequent - states
    for k, s in enumerate(streams):
        want = 0.0
        for i in range(1, len(s)):
            c = tuple(s[max(0, i - lm.DEPTH) : i])
            while c and c not in states:
                c = c[1:]
            want += math.log10(p(c, s[i]))
        assert math.isclose(rows[k], want, rel_tol=1e-9), (k, found)


def test_next_tokens_that_are_rare_are_not_counted_one_by_one(spark, make_docs, monkeypatch):
    """Words are frequent and most of their pairs are not, so few pairs are shuffled to be counted."""
    counted, real = [], lm._counted

    def spy(source, keys):
        rows = real(source, keys)
        counted.append(rows.where("depth = 1").count())
        return rows

    monkeypatch.setattr(lm, "_counted", spy)
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(60)) for _ in range(700)] + ["w1 w2 w3"] * 600
    rows = {r.doc_id: r for r in lm.score(make_docs(texts), F.lit(True)).collect()}
    pairs = Counter()
    for t in texts:
        own = ["<", *t.split(), ">"]
        pairs.update(zip(own, own[1:]))
    frequent = sum(n >= lm.LEAST for n in pairs.values())
    assert frequent < 0.2 * len(pairs)
    # Words are counted first, then contexts of one word.
    assert frequent <= counted[1] < 0.1 * len(pairs)  # some share a place
    assert rows[len(texts) - 1].score > rows[len(texts) - 1].base_score


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_held_values_are_found(n):
    rng = np.random.default_rng(n)
    keys = np.unique(np.append(rng.integers(0, 2**64, n, np.uint64), np.array([0, 2**64 - 1] if n > 2 else [], np.uint64)))
    rows = pa.table({"key": pa.array(keys.view(np.int64)), "value": pa.array(np.arange(len(keys)) + 1.0)})
    asked = np.concatenate([keys, keys + np.uint64(1), keys - np.uint64(1), rng.integers(0, 2**64, 100, np.uint64)])
    values, known = lm.Held(rows, "key").find(asked)
    own = {int(k): v for v, k in enumerate(keys, 1)}
    assert values.tolist() == [own.get(int(k), 0) for k in asked] and known.tolist() == [int(k) in own for k in asked]


def test_a_context_of_enough_evidence_is_a_state_in_any_corpus(spark, make_docs):
    """A context seen 1,000 times is used, however many other tokens there are."""
    own = ["red fox jumps"] * 1000
    gained = []
    for others in (0, 2000):
        rng = random.Random(others)
        noise = [" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) + " red house" for _ in range(others)]
        rows = {r.doc_id: r for r in lm.score(make_docs(own + noise), F.lit(True)).collect()}
        gained.append(rows[0].score - rows[0].base_score)
        # All but the first word follow from the words before them.
        assert rows[0].score > math.log10(1000 / (1000 + others)) + 3 * math.log10(0.99)
    assert gained[1] > gained[0] > 0


# licenses


def brute_licenses(text, name, body):
    w, t = words(lower(text or "")), words(lower(body))
    width = min(5, len(t))
    gram = lambda x, k: tuple(x[k : k + width])
    goal = {gram(t, k) for k in range(len(t) - width + 1)}
    size = len(t) - width + 1
    best = []
    for at in range(max(1, len(w) - len(t) + 1)):
        n = len(goal & {gram(w, k) for k in range(at, min(at + size, len(w) - width + 1))})
        if 100 * n >= 75 * len(goal):
            best.append((-n, at))
    out = []
    for n, at in sorted(best):
        if all(at + len(t) <= a or a + len(t) <= at for a in out):
            out.append(at)
    return bool(out), max((-n for n, _ in best), default=0), len(goal)


def test_licenses_equal_brute_force(spark, make_docs):
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet the license under".split()) for _ in range(n))
    texts = list(ODD)
    for name, body in licenses.TEMPLATES.items():
        t = body.split()
        texts += [body, f"{filler(rng.randint(0, 90))} {body.upper()} {filler(50)} {body}", " ".join(t[: len(t) // 2])]
        cut = t[:]
        cut[0] = "changed"
        texts.append(f"{filler(33)}\n{' '.join(cut)} {filler(3)}")
    found = {}
    for r in licenses.scan(clashing(make_docs(texts))).collect():
        found.setdefault((r.doc_id, r.license), []).append(r)
    for k, text in enumerate(texts):
        for name, body in licenses.TEMPLATES.items():
            there, most, goal = brute_licenses(text, name, body)
            own = found.get((k, name), [])
            assert bool(own) == there, (text, name)
            if own:
                assert max(r.n_shared for r in own) == most and max(r.containment for r in own) == most / goal
    assert licenses.scan(make_docs([])).collect() == []


def test_license_bands_meet_the_guarantee():
    for n in range(5, 120):
        p = licenses.least_similarity(n) ** licenses.ROWS
        assert 1 - (1 - p) ** licenses.bands_of(n) >= licenses.RETRIEVED - 1e-12


# mixing


def test_rates_reach_targets_and_equal_plain_descent(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    n = rng.integers(1, 500, 200)
    rows = [(k, int(n[k]), p[k].tolist()) for k in range(200)]
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, p array<double>")
    want = {"a": 0.5 * n.sum(), "b": 0.1 * n.sum(), "c": 0.05 * n.sum()}
    fit = mixing.fit_rates(members, ("a", "b", "c"), want)
    rate = np.array([r.rate for r in members.withColumn("rate", fit.rate).orderBy("doc_id").collect()])
    totals = (rate * n) @ p
    assert (rate >= 0).all() and np.allclose(totals, [fit.reached[k] for k in "abc"])
    assert np.allclose(totals, list(want.values()), atol=2e-3 * max(want.values()))
    gram = (p * n[:, None]).T @ p
    scale = 1 / np.diag(gram)
    step = 1 / (np.sqrt(np.outer(scale, scale)) * gram).sum(1).max()
    plain = np.ones(200)
    for _ in range(fit.rounds):
        plain = np.maximum(0, plain - p @ (step * scale * ((plain * n) @ p - np.array(list(want.values())))))
    assert np.allclose(plain, rate)


def test_rates_reach_small_targets_and_tell_what_they_miss(spark):
    # 0.05 % of the tokens are toxic and the clean total is right from the start.
    rows = [(k, 100, [1.0, 0.0]) for k in range(1999)] + [(1999, 100, [0.0, 1.0])]
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, p array<double>")
    fit = mixing.fit_rates(members, ("clean", "toxic"), {"clean": 199_900, "toxic": 5})
    assert not fit.missed and math.isclose(fit.reached["toxic"], 5, rel_tol=mixing.CLOSE)
    assert math.isclose(members.where("doc_id = 1999").select(fit.rate).first()[0], 0.05, rel_tol=mixing.CLOSE)
    # Too few rounds of descent leave the rest to Newton's method.
    rng = np.random.default_rng(2)
    p = rng.dirichlet([4.0, 1.0, 0.2], 300)
    members = spark.createDataFrame([(k, 50, p[k].tolist()) for k in range(300)], "doc_id long, n_tokens long, p array<double>")
    want = dict(zip("abc", 50 * np.array([0.6, 0.5, 0.4]) @ np.diag(p.sum(0))))
    fit = mixing.fit_rates(members, ("a", "b", "c"), want, rounds=2)
    rate = np.array([r.rate for r in members.withColumn("rate", fit.rate).orderBy("doc_id").collect()])
    assert (rate >= 0).all() and not fit.missed and np.allclose((rate * 50) @ p, list(want.values()), rtol=1.01 * mixing.CLOSE)
    with pytest.warns(UserWarning, match="misses"):
        impossible = mixing.fit_rates(members.limit(1), ("a", "b", "c"), {"a": 0, "b": 0, "c": 50.0})
    assert impossible.missed


def test_mixing_of_documents(spark, make_docs):
    texts = ["good words here and there " * 9] * 20 + ["awful stupid words " * 9] * 20 + [None, "", "### $$$ %%%"]
    docs = clashing(make_docs(texts))
    labels = spark.createDataFrame(
        [(k, 1, int(k >= 20)) for k in range(0, 40, 2)] + [(41, None, 0), (99, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int"
    )
    rows = {r.doc_id: r for r in mixing.mix(docs, labels, {"clean": 0.9, "toxic": 0.1}).collect()}
    assert len(rows) == len(texts) and rows[40].n_tokens == 1
    assert rows[1].p_clean > 0.9 and rows[21].p_toxic > 0.9 and rows[1].rate > rows[21].rate >= 0
    assert {r.rate for r in mixing.mix(docs, labels.limit(0)).collect()} == {1.0}
    assert mixing.mix(make_docs([]), labels).collect() == []


# quality ledger


def brute_quality(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    seen = Counter(grams)
    covered = {p for k, g in enumerate(grams) if seen[g] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_equal_brute_force(spark, make_docs):
    rng = random.Random(8)
    texts = [*ODD, *("".join(rng.choice("ab \n\n#|é") for _ in range(rng.randint(0, 80))) for _ in range(150))]
    texts += ["x y z " * 400, "a b\na b\na b", "1 2 3 4 1 2 3"]
    rows = {r.doc_id: r for r in quality.ledger(clashing(make_docs(texts))).collect()}
    for k, text in enumerate(texts):
        r = rows[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(text), repr(text)


def test_policies_and_ablations(spark, make_docs):
    texts = ["a b c " * 40, "few", " ".join(f"w{k}" for k in range(60)), "### " * 70, None]
    rows = quality.ledger(make_docs(texts))
    base, newest = quality.POLICIES[0], quality.POLICIES[-1]
    kept = [r.kept for r in quality.apply_policy(rows, base).orderBy("doc_id").collect()]
    assert kept == [False, False, True, False, False]
    found = {r.rule: r for r in quality.ablations(rows, newest).collect()}
    failed = [r.failed for r in rows.orderBy("doc_id").collect()]
    for k, rule in enumerate(quality.RULES):
        r = found[rule.name]
        assert r.n_failed == sum(f >> k & 1 for f in failed)
        assert r.n_failed_alone == sum(f == 1 << k for f in failed)
        assert r.n_kept_without == sum(f & ~(1 << k) == 0 for f in failed)
    assert quality.ledger(make_docs([])).collect() == []
