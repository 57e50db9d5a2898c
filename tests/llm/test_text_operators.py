"""Classifiers, tokenizers, packing and media: brute force, round trips, held-out accuracy and odd inputs."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, jpeg_media, language_id, packing, token_counts, toxicity
from tessera.llm.letters import letters_only
from tessera.llm.words import rolling, text_words, word_hashes

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, tokens int, score string, predicted int"
LONG = "palabra larga und so weiter le mot " * 30_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and columns with clashing names."""
    rows = [(1, None, "en"), (2, "", "en"), (3, "   \n", None), (4, LONG, "es"), (5, "same text", "en"), (5, "same text", "en"), (None, "no id", None), (7, "12 34 !!", "en"), (8, "日本語 ünï 🙂", "ja")]
    return spark.createDataFrame([(i, t, lang, None, None, "x", 1, "s", 9) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- words ---------------------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aB9é- \n.ß🙂")), max_size=40), min_size=1, max_size=6))
def test_word_hashes_are_hashes_of_words(texts):
    hashes, bounds = word_hashes(texts)
    words = [w for t in texts for w in text_words(t)]
    assert np.diff(bounds).tolist() == [len(text_words(t)) for t in texts]
    assert len({(w, h) for w, h in zip(words, hashes.tolist(), strict=True)}) == len(set(words)) == len(set(hashes.tolist()))
    grams, edges = rolling(hashes, bounds, 3)
    expected = [tuple(own[i : i + 3]) for t in texts for own in [text_words(t)] for i in range(len(own) - 2)]
    assert len(grams) == edges[-1] == len(expected) and len(set(expected)) == len(set(grams.tolist()))


# --- 1 language ----------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    rows = language_id.op1_language_id(spark, LARGER).join(spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out and 0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark, odd, empty):
    model = language_id.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))
    rows = language_id.identify(odd, model).collect()
    assert len(rows) == 9
    by = {r.doc_id: r for r in rows}
    assert {by[i].lang_pred for i in (1, 2, 3, 7)} == {"und"} and by[1].score == 0 and by[1].rejected
    assert by[4].lang_pred in model.languages and by[None].lang_pred in model.languages
    assert language_id.identify(empty, model).count() == 0
    untaught = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.identify(odd, untaught).collect()} == {"und"}


def test_language_of_long_texts_only_is_learned(spark):
    """A language that stands in no text of under 200,000 characters trains and is predicted."""
    rows = spark.range(60).withColumn("lang", F.expr("CASE WHEN id % 2 = 0 THEN 'en' ELSE 'xx' END"))
    text = F.expr("CASE WHEN id % 2 = 0 THEN concat('these are the common words of short texts ', translate(id, '0123456789', 'abcdefghij')) ELSE repeat('zulqo vymax krewip odjuf ', 9000) END")
    model = language_id.fit(rows.select(F.col("id").alias("doc_id"), "lang", text.alias("text")))
    assert model.languages == ["en", "xx"]
    assert model.predict([" krewip zulqo odjuf ", " the common words "])[0] == ["xx", "en"]


def test_language_subwords_stay_inside_texts():
    alone = [language_id.subwords([t], 14)[0].tolist() for t in (" ab cd ", "", " x ")]
    together, bounds = language_id.subwords([" ab cd ", "", " x "], 14)
    assert [sorted(together[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [sorted(a) for a in alone]


# --- 2 toxicity ----------------------------------------------------------------------------------------------------


def test_toxicity_learns_spans():
    rng = np.random.default_rng(1)
    syllables = ["ra", "men", "tol", "sib", "qua", "ner", "dop", "lin", "sta", "wer"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 5)))
    plain = lambda: [word() for _ in range(rng.integers(20, 200))]
    bad = ["vexhog", "zugfip", "krakbox"]

    def toxic():
        words = plain()
        for _ in range(max(2, len(words) // 25)):
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(bad)))
        return words

    text = lambda words: f" {' '.join(words)} "
    model = toxicity.train([text(toxic()) for _ in range(150)], [text(plain()) for _ in range(400)])
    hits, false = model.score([text(toxic()) for _ in range(100)]) >= 0.5, model.score([text(plain()) for _ in range(100)]) >= 0.5
    assert hits.mean() >= 0.95 and false.mean() <= 0.03


def test_toxicity_is_its_formula(spark):
    """Scores against a plain computation: every window compressed by zstandard with each dictionary, then the curve."""
    import zstandard

    documents = spark.read.parquet(f"{LARGER}/documents.parquet")
    model = toxicity.fit(documents, spark.read.parquet(f"{LARGER}/labels.parquet"))
    assert len(model.toxic) <= max(toxicity.TOXIC_BYTES) and len(model.ordinary) > len(model.toxic)

    def length(dictionary, window):
        own = zstandard.ZstdCompressor(
            dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            compression_params=zstandard.ZstdCompressionParameters.from_level(8, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, write_checksum=False, min_match=6, window_log=18, search_log=6),
        )
        return len(own.compress(window))

    out = {r.doc_id: r.score for r in toxicity.score(documents, model).collect()}
    for r in documents.select("doc_id", letters_only(F.col("text")).alias("t")).filter("length(text) < 1500").limit(25).collect():
        words = r.t.split()
        text, found = r.t.encode(), []
        cuts = [i for i, b in enumerate(text[:-1]) if b == 32][:: toxicity.WINDOW] + [len(text) - 1]
        assert len(cuts) == -(-len(words) // toxicity.WINDOW) + 1 or not words
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            window = b"".join(((text[k] << 8 | text[k + 1]) * toxicity.PAIR_FACTOR % 65536).to_bytes(2, "little") for k in range(i, j))
            found.append(length(model.ordinary, window) - length(model.toxic + model.ordinary, window))
        best = [min(max(g, 0), toxicity.MOST) for g in (sorted(found, reverse=True) + [0, 0, 0])[:3]]
        z = float(np.dot(model.weights, [*best, np.log1p(len(found)), 1.0]))
        assert abs(out[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-9


def test_samples_are_bounded_for_repeated_ids(spark):
    """One id on nearly all rows brings one row, and long texts bring passages from all over them."""
    from tessera.llm.letters import class_sample

    rows = spark.range(5000).selectExpr("CASE WHEN id < 4900 THEN 7 ELSE id END AS doc_id", "'en' AS lang", "concat('text ', id) AS text")
    assert class_sample(rows, "lang", 100_000).count() == 101 and class_sample(rows, "lang", 50).count() <= 101
    seen = []
    words = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(12_000))
    docs = spark.createDataFrame([(i, words if i < 3 else f"short text of row {chr(97 + i)}") for i in range(20)] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 6)) for i in range(20)], "doc_id long, toxic int")
    own, toxicity.train = toxicity.train, lambda toxic, ordinary: seen.append((toxic, ordinary))
    try:
        toxicity.fit(docs, labels, max_chars=4000)
    finally:
        toxicity.train = own
    toxic, ordinary = seen[0]
    assert len(toxic) == 6 and len(ordinary) == 14 and max(map(len, toxic)) <= 4000 + toxicity.PASSAGES + 2
    long = next(t for t in toxic if len(t) > 1000)
    assert words[:40] in long and words[-2980:-2850] in long


def test_a_hot_id_takes_no_place_in_the_sample(spark):
    """An id on nearly all rows, and labels without end: the other ids and the commonest classes are drawn as without them."""
    from tessera.llm.letters import class_sample

    rows = spark.range(40_600).selectExpr("greatest(id - 40000, -1) AS doc_id", "CASE WHEN id % 2 = 0 OR id < 40000 THEN 'en' ELSE 'fr' END AS lang", "'text' AS text")
    drawn = {r.lang: r.n for r in class_sample(rows, "lang", 100).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert set(drawn) == {"en", "fr"} and all(60 <= n <= 150 for n in drawn.values())
    dirty = spark.range(2000).selectExpr("id AS doc_id", "CASE WHEN id < 1000 THEN 'en' ELSE concat('x', id) END AS lang", "'text' AS text")
    assert {r.lang for r in class_sample(dirty, "lang", 5000, classes=1).collect()} == {"en"} and class_sample(dirty, "lang", 5000).select("lang").distinct().count() == 256
    none = spark.createDataFrame([(None, "en", "t")], "doc_id long, lang string, text string")
    assert class_sample(none, "lang", 5).count() == 0


def test_long_texts_are_read_in_pieces():
    """Pieces keep every subword of every word, whatever their size."""
    from tessera.llm.language_id import bucket_counts, subwords
    from tessera.llm.letters import bounded

    rng = np.random.default_rng(3)
    texts = ["", " é ", *(" " + " ".join("".join(rng.choice(list("abéß"), rng.integers(1, 9))) for _ in range(n)) + " " for n in (1, 3, 40, 400)), " " + "x" * 90 + " y "]
    for limit in (1, 7, 64, 1 << 18):
        groups = list(bounded(texts, limit))
        assert all(sum(map(len, parts[:-1])) < limit for _, parts in groups)
        counts = [Counter() for _ in texts]
        for owners, parts in groups:
            buckets, bounds = subwords(parts, 14)
            for owner, a, b in zip(owners, bounds[:-1], bounds[1:], strict=True):
                counts[owner].update(buckets[a:b].tolist())
        for text, own in zip(texts, counts, strict=True):
            assert own == Counter(subwords([text], 14)[0].tolist())
    long = texts[5] * 2000  # over the size of a piece
    (found, n), (buckets, _) = bucket_counts([long], 14)[0], subwords([long], 14)
    assert dict(zip(found.tolist(), n.tolist(), strict=True)) == Counter(buckets.tolist()) and len(long) > 2 << 18


def test_one_very_long_text_takes_little_memory():
    import tracemalloc

    from tessera.llm.language_id import UNDETERMINED, bucket_counts, train

    model = train([("en", *bucket_counts([" the cat and that "], 14)[0]), ("fr", *bucket_counts([" le chat et que "], 14)[0])])
    text = " le chat et que" * 700_000 + " "
    tracemalloc.start()
    language, _ = model.predict([text])
    bucket_counts([text], 14)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert language == ["fr"] != [UNDETERMINED] and peak < 120e6 and len(text) > 10e6


def test_toxicity_sample_keeps_texts_that_share_passages():
    """Texts with a third of their words in common passages stay; copies and near copies go."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    passages = [[word() for _ in range(15)] for _ in range(8)]
    own = [[word() for _ in range(70)] + passages[i % 8] + passages[(i // 8) % 8] for i in range(300)]
    texts = [f" {' '.join(words)} " for words in own]
    assert len(toxicity.without_copies(texts)) >= 0.95 * len(texts)
    near = [f" {' '.join([*words[:40], word(), *words[41:]])} " for words in own]
    assert len(toxicity.without_copies(texts + texts)) == len(toxicity.without_copies(texts))
    assert len(toxicity.without_copies(texts + near)) <= 1.1 * len(texts)
    assert toxicity.without_copies([" a b ", " a b ", " b a ", " a "]) == [" a b ", " b a ", " a "]


def test_toxicity_query_and_odd_rows(spark, odd, empty):
    rows = toxicity.op2_toxicity(spark, LARGER).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    known = [(labels[r.doc_id], r.score) for r in rows if r.doc_id in labels]
    toxic, clean = [s for y, s in known if y], [s for y, s in known if not y]
    assert np.mean([(t > c) + (t == c) / 2 for t in toxic for c in clean]) > 0.8  # area under the curve; few labels here, some of them noise
    documents, own = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    model = toxicity.fit(documents, own)
    out = toxicity.score(odd, model).collect()
    assert len(out) == 9 and len({r.score for r in out if r.doc_id in (1, 2, 3, 7)}) == 1 and len({r.score for r in out if r.doc_id == 5}) == 1
    assert toxicity.score(empty, model).count() == 0
    untaught = toxicity.fit(documents, own.filter("false"))
    assert {r.score for r in toxicity.score(odd, untaught).collect()} == {0.0}


def test_windows_are_the_whole_text():
    text = " " + " ".join(f"w{i}" for i in range(50)) + " "
    assert sum(map(len, toxicity.windows(text))) == 2 * (len(text) - 1)
    assert toxicity.windows("") == []


# --- 4 and 5 tokens ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="session")
def reference():
    import tiktoken

    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABET = st.sampled_from(list("aabthe 'srevld\n\t 12é日🙂!.") + ["'re", "ing", "  "])


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, max_size=60).map("".join))
def test_replay_is_the_library(reference, text):
    codec = byte_bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    ids = codec.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
    assert codec.decode(ids).decode() == text


def test_replay_goes_back_for_lower_ranks():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 256, b"cd": 301}  # abc ranks before what it is made of
    own = byte_bpe.MergeReplay(ranks)
    assert own.encode([b"abcbcd", b"aaa", b""]) == [[256, 300, ranks[b"d"]], [97, 97, 97], []]


def test_replayed_bytes_are_plain_merges():
    """Empty words, tokens, single bytes, no words at all and words beside each other that would merge if they met."""
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    own = byte_bpe.MergeReplay(ranks)

    def plain(word):
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            rank, k = min((ranks.get(a + b, len(ranks)), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == len(ranks):
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return b"".join(ranks[p].to_bytes(4, "little") for p in parts)

    draw = np.random.default_rng(7)
    some = [draw.choice(np.frombuffer("aaethé🙂 ".encode(), np.uint8), n).tobytes() for n in draw.integers(0, 40, 400)]
    for words in ([], [b""], [b"a"], [b"", b"the", b"", b"t", b"h"], [b"\xff\xfe", b"\xff", b"thethethe" * 30, b"x" * 99], [b"q\x00", b"\x00q"], some):
        assert own.encode_bytes(words) == list(map(plain, words))
        assert own.encode(words) == [np.frombuffer(plain(w), "<u4").tolist() for w in words]


def test_counts_in_waves_are_those_of_the_replay(monkeypatch):
    """Many short words are merged in step: only those too long to lie side by side are replayed one merge after another."""
    own = token_counts.TokenCounter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    draw, tokens = np.random.default_rng(5), list(own.replay.ranks)
    words = [b"".join(tokens[i] for i in draw.integers(0, len(tokens), n)) for n in draw.integers(0, 9, 2000)]
    words += [draw.choice(np.frombuffer("aaethé🙂 ".encode(), np.uint8), n).tobytes() for n in draw.integers(0, 60, 2000)] + [b"a" * n for n in range(80)]
    expected = list(map(len, own.replay.encode(words)))
    replayed, encode = [], own.replay.encode
    monkeypatch.setattr(own.replay, "encode", lambda some: replayed.extend(some) or encode(some))
    assert own.replay.count(words) == expected
    assert all(len(word) > byte_bpe.WIDTHS[-1] for word in replayed)
    back = byte_bpe.MergeReplay({bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 256, b"cd": 301})
    assert back.count([b"abcbcd", b"aaa", b"", b"bc"] * byte_bpe.WAVE_WORDS) == [3, 3, 0, 1] * byte_bpe.WAVE_WORDS
    spelled = {f"Wort{i}x{i * i}" for i in range(5 * byte_bpe.WAVE_WORDS)}
    replayed.clear()
    own.learn([spelled])
    assert not replayed and [own.cache[w] for w in sorted(spelled)] == [len(ids) for ids in encode([w.encode() for w in sorted(spelled)])]


def test_a_tree_counts_pieces_that_left_the_cache():
    """Edits look a leaf's pieces up where they are held and count only those that are not."""
    own = token_counts.TokenCounter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, cache_bytes=1)
    text = " ".join(f"word{i}" for i in range(300))
    pieces = own.split(text)
    tree = token_counts.CountedText(pieces, own)  # none of them was learned before
    for k in range(3):
        own.learn([["other", f"new{k}"]], may_turn=True)
    tree.edit(700, 705, "x y")
    text = text[:700] + "x y" + text[705:]
    assert tree.text() == text and tree.n_tokens == sum(map(len, own.replay.encode([p.encode() for p in own.pattern.findall(text)])))


def test_codec_query(spark, reference, odd, empty):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in byte_bpe.op5_byte_bpe(spark, SMALL).collect():
        ids = reference.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    path = P.path("byte_bpe_50k.tiktoken")
    rows = byte_bpe.digest_documents(odd, path, P.PATTERN).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(rows) == 9 and {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows if r.doc_id in (1, 2)} == {(0, nothing, nothing)}
    assert byte_bpe.digest_documents(empty, path, P.PATTERN).count() == 0
    assert {bytes(r.decoded).decode() for r in byte_bpe.encode_documents(odd, path, P.PATTERN).collect() if r.doc_id == 4} == {LONG}


EDITS = st.lists(st.tuples(st.integers(0, 90), st.integers(0, 30), st.lists(ALPHABET, max_size=8).map("".join)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, max_size=80).map("".join), EDITS)
def test_edited_counts_are_fresh_counts(reference, text, edits):
    own = token_counts.counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    pieces = own.pattern.findall(text)
    own.learn([pieces])
    tree = token_counts.CountedText(pieces, own)
    for start, size, replacement in edits:
        tree.edit(start, start + size, replacement)
        start = min(start, len(text))
        text = text[:start] + replacement + text[start + size :]
        assert tree.text() == text and tree.n_tokens == len(reference.encode_ordinary(text)) and tree.n_chars == len(text)


def test_edits_recount_little(spark, reference, odd, empty):
    own = token_counts.counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    text = "word and another one. " * 20_000
    pieces = own.pattern.findall(text)
    own.learn([pieces])
    tree = token_counts.CountedText(pieces, own)
    for at in range(1000, 400_000, 4000):
        tree.edit(at, at + 3, "x")
    assert tree.recounted < 100 * 200 and tree.n_tokens == len(reference.encode_ordinary(tree.text()))
    path = P.path("byte_bpe_50k.tiktoken")
    rows = token_counts.count_edited(odd, token_counts.sample_edits(F.col("text")), path, P.PATTERN).collect()
    text = ""
    for e in odd.filter("doc_id = 2").select(token_counts.sample_edits(F.col("text")).alias("e")).first().e:
        start, stop = min(e.start, len(text)), min(e.stop, len(text))
        text = text[:start] + (e.replacement or "") + text[stop:]
    assert len(rows) == 9 and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {len(reference.encode_ordinary(text))} and len({r.n_tokens for r in rows if r.doc_id == 5}) == 1
    none = token_counts.count_edited(odd, F.lit(None).cast("array<struct<start:long,stop:long,replacement:string>>"), path, P.PATTERN).collect()
    assert all(r.tokens_before == r.n_tokens and r.recounted_chars == 0 for r in none)
    assert token_counts.count_edited(empty, token_counts.sample_edits(F.col("text")), path, P.PATTERN).count() == 0


def test_kept_trees_take_rounds_of_edits(spark, reference):
    path = P.path("byte_bpe_50k.tiktoken")
    texts = {1: "some words, and more of them. " * 200, 2: "", 3: "untouched text"}
    docs = spark.createDataFrame([*texts.items(), (4, None)], "doc_id long, text string")
    trees = token_counts.kept_trees(docs, path, P.PATTERN)
    rounds = [[(1, 0, 5, 9, "X"), (1, 1, 4000, 4000, " tail's"), (2, 0, 0, 0, "new")], [(2, 0, 1, 2, "ee"), (1, 0, 0, 100, None)]]
    for edits in rounds:
        trees = token_counts.edited_trees(trees, spark.createDataFrame(edits, "doc_id long, seq int, start long, stop long, replacement string"), path, P.PATTERN)
        for doc_id, _, start, stop, replacement in edits:
            text = texts[doc_id]
            texts[doc_id] = text[: min(start, len(text))] + (replacement or "") + text[min(stop, len(text)) :]
    out = {r.doc_id: r for r in trees.collect()}
    assert all("".join(out[k].pieces) == t and out[k].n_tokens == sum(out[k].counts) == len(reference.encode_ordinary(t)) for k, t in texts.items())
    assert out[3].recounted_chars == 0 and 0 < out[1].recounted_chars < 300 and out[4].n_tokens == 0


def test_kept_trees_of_odd_edits(spark, reference, monkeypatch):
    """Edits without a range, of unknown or null documents, ties, repeated trees, and more edits than one task applies."""
    monkeypatch.setattr(token_counts, "EDITS_AT_ONCE", 4)
    path = P.path("byte_bpe_50k.tiktoken")
    base = "some words, and more of them. " * 50
    docs = spark.createDataFrame([(1, base), (2, "same text"), (2, "same text"), (3, ""), (None, "no id"), (5, "left alone")], "doc_id long, text string")
    todo = [(1, i, 7 * i, 7 * i + i % 3, f"w{i} ") for i in range(11)] + [(2, 0, None, 3, "x"), (2, 1, 0, None, "y"), (2, None, 0, 4, None), (9, 0, 0, 0, "q"), (None, 0, 0, 0, "z"), (3, 0, 5, 9, "new words")]
    edits = spark.createDataFrame([(d, n, a, b, r) for d, n, a, b, r in todo], "doc_id long, seq int, start long, stop long, replacement string")
    kept = token_counts.kept_trees(docs, path, P.PATTERN)
    out = token_counts.edited_trees(kept, edits, path, P.PATTERN).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "2", "2", "3", "5", "None"]
    text = base
    for _, _, a, b, r in todo[:11]:
        text = text[:a] + r + text[b:]
    want = {1: text, 2: " text", 3: "new words", None: "no id", 5: "left alone"}
    for r in out:
        own = want[r.doc_id]
        assert "".join(r.pieces) == own and r.n_tokens == len(reference.encode_ordinary(own)) == sum(r.counts) and r.chars[1] == len(own) and sum(r.leaf_sizes) == len(r.pieces)
    assert {r.doc_id: r.recounted_chars for r in out}[5] == 0
    assert token_counts.edited_trees(kept.filter("false"), edits, path, P.PATTERN).count() == 0
    assert token_counts.edited_trees(kept, edits.filter("false"), path, P.PATTERN).count() == 6


def test_long_texts_are_split_in_parts(reference):
    from tessera.llm.word_cache import segments

    text = "".join(f"wort{i % 50}!\n\n  and   it's {i} \t;" for i in range(4000))
    parts = list(segments(text, 1000))
    assert "".join(parts) == text and len(parts) > 50
    own = byte_bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, cache_bytes=10_000)
    assert sum((reference.encode_ordinary(p) for p in parts), []) == reference.encode_ordinary(text)
    for some in (text, "x" * 3000, "1234 " * 1000):
        assert np.frombuffer(own.encode([some, some])[1], "<u4").tolist() == reference.encode_ordinary(some)
    assert list(segments("")) == [""]


def test_edit_query(spark, reference):
    rows = token_counts.op4_token_counts(spark, SMALL).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    edits = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", token_counts.sample_edits(F.col("text")).alias("e"))
    todo = {r.doc_id: r.e for r in edits.collect()}
    for r in rows:
        own = text[r.doc_id]
        assert r.tokens_before == len(reference.encode_ordinary(own))
        for e in todo[r.doc_id]:
            start, stop = min(e.start, len(own)), min(e.stop, len(own))
            own = own[:start] + (e.replacement or "") + own[stop:]
        assert r.n_tokens == len(reference.encode_ordinary(own)) and r.n_chars == len(own)


# --- 6 packing -----------------------------------------------------------------------------------------------------


def check_packed(rows, ids, capacity=4096):
    by_document, by_sequence = {}, {}
    for r in rows:
        by_document.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_document) == set(ids)
    for doc_id, pieces in by_document.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            own = ids[doc_id][p.start : p.start + p.length]
            assert p.start == at and p.doc_tokens == len(ids[doc_id]) and p.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
            at += p.length
        assert at == len(ids[doc_id])
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return by_sequence


def test_packing_is_whole_and_tight(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    ids = {k: tokenizer.encode(t, add_special_tokens=False).ids + [2] for k, t in text.items()}
    sequences = check_packed(packing.op6_packing(spark, LARGER).collect(), ids)
    assert sum(map(len, ids.values())) >= 0.99 * 4096 * len(sequences)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 9), min_size=1, max_size=8))
def test_fill_uses_every_piece_once(counts):
    patterns = packing.fill(counts, 24)
    used = {}
    for pattern, windows in patterns:
        assert windows > 0 and sum(length * n for length, n in pattern.items()) <= 24
        for length, n in pattern.items():
            used[length] = used.get(length, 0) + n * windows
    assert used == counts


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), min_size=1, max_size=5))
def test_first_window_has_least_slack(counts):
    from itertools import product

    pattern, _ = packing.fill(counts, 20)[0]
    seed = max(counts)
    rest = dict(counts)
    rest[seed] -= 1
    sums = {sum(length * n for (length, _), n in zip(rest.items(), ns, strict=True)) for ns in product(*(range(n + 1) for n in rest.values()))}
    assert sum(length * n for length, n in pattern.items()) == seed + max(s for s in sums if s <= 20 - seed)


def test_packing_odd_rows(spark, odd, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    once = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2] for r in once.collect()}
    check_packed(packing.pack(once, P.path("word_bpe_49k.json")).collect(), ids)
    assert packing.pack(odd, P.path("word_bpe_49k.json")).filter("doc_id = 5").count() == 2
    assert packing.pack(empty, P.path("word_bpe_49k.json")).count() == 0


def test_packing_ranks_a_hot_length_in_many_tasks(spark, monkeypatch):
    """Nearly all pieces have one length, some rows are repeated a thousand times: salts follow the counts."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "RANKED_ROWS", 50)
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [(i, "one two three") for i in range(3000)] + [(5000, "word " * 200)] + [(6000 + i, "more words " * (i % 7)) for i in range(100)]
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids + [2] for i, t in rows}
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    sequences = check_packed(packing.pack(frame(rows), P.path("word_bpe_49k.json"), 256).collect(), ids, 256)
    assert sum(map(len, ids.values())) >= 0.98 * 256 * len(sequences)
    copies = packing.pack(frame([(None, "one two three")] * 1000), P.path("word_bpe_49k.json"), 256).collect()
    assert len({(r.sequence_id, r.offset) for r in copies}) == 1000


def test_packing_of_letters_the_library_does_not_know(spark):
    """Letters newer than the library's tables, in short texts and in one that is split into words in parts."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    own = packing.WordTokens(P.path("word_bpe_49k.json"), cache_bytes=20_000)
    texts = ["ab\u0558cd it's", "x\u088f \u208f1 don't", "caf\u00e9 e\u0301 \u3000\u2028 \x1cz", "wort und satz 12, don't! \u0301 " * 60_000 + "\u0c5c end", "".join(f"w{i} " for i in range(3000)), ""]
    for _ in range(2):
        assert own.encode(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_packing_keeps_added_tokens(spark):
    """Literals of added tokens have ids of their own, wherever they stand; what only resembles them has not."""
    from tokenizers import Tokenizer

    end, start = "<|endoftext|>", "<|startoftext|>"
    texts = [f"{start}Erste Zeile{end}{end} ΑΣ{start}'s don't", end, f"a{end}b <|ENDOFTEXT|> <|endoftext |> <{end}>", f"e{end}\u0301 cafe\u0301 {start} {start}", f"{'wort ' * 5000}{end}{'x y ' * 3000}{start}"]
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    assert all({49406, 49407} & set(own) for own in ids.values())
    docs = spark.createDataFrame([(i, t, None, None, None, "x", 1, "s", 9) for i, t in enumerate(texts)], SCHEMA)
    check_packed(packing.pack(docs, P.path("word_bpe_49k.json")).collect(), ids)


# --- 8 media -------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=900), min_size=1, max_size=5))
def test_media_round_trip(payloads):
    payloads = [p + bytes(-len(p) % 192) for p in payloads]
    files = jpeg_media.write(payloads)
    media = jpeg_media.read(files)
    assert [jpeg_media.stored_bytes(m) for m in media] == payloads
    assert all((m.width // 8) * (m.height // 8) * 192 >= len(p) for m, p in zip(media, payloads, strict=True))


def slow_decode(data: bytes) -> list[list[int]]:
    """Coefficients of every block, bit by bit."""
    frame = jpeg_media.parse(data)
    bits = "".join(f"{b:08b}" for b in b"".join(jpeg_media.segments(data, frame.at)[:1]))
    tables = {}
    for key, codes in frame.codes.items():
        code, at, own = 0, 16, {}
        for n in range(1, 17):
            for s in codes[at : at + codes[n - 1]]:
                own[f"{code:0{n}b}"] = s
                code += 1
            at += codes[n - 1]
            code <<= 1
        tables[key] = own
    at = 0

    def symbol(table):
        nonlocal at
        n = 1
        while bits[at : at + n] not in table:
            n += 1
        at += n
        return table[bits[at - n : at]]

    def value(size):
        nonlocal at
        if not size:
            return 0
        v = int(bits[at : at + size], 2)
        at += size
        return v if v >> (size - 1) else v - (1 << size) + 1

    blocks, predicted = [], {}
    columns, rows = frame.mcu_grid
    for _ in range(columns * rows):
        for (c, _, _), (dc, ac) in zip(frame.layout, [frame.scan[c] for c, _, _ in frame.layout], strict=True):
            block = [0] * 64
            predicted[c] = predicted.get(c, 0) + value(symbol(tables[0, dc]))
            block[0] = predicted[c]
            k = 1
            while k < 64:
                rs = symbol(tables[1, ac])
                if not rs & 15:
                    if rs >> 4 != 15:
                        break
                    k += 16
                    continue
                k += rs >> 4
                block[k] = value(rs & 15)
                k += 1
            blocks.append(block)
    return blocks


def foreign_file(rng) -> bytes:
    """A 4:2:0 file of another writer's kind: other tables, runs of zeros, ends of block, no restart markers."""
    import struct

    dc_codes = bytes([0, 3, 2, *[0] * 13]) + bytes([0, 2, 4, 1, 3])
    ac_codes = bytes([0, 2, 1, 3, *[0] * 12]) + bytes([0x00, 0x01, 0x02, 0x12, 0xF0, 0x31])

    def canonical(codes):
        out, code, at = {}, 0, 16
        for n in range(1, 17):
            for s in codes[at : at + codes[n - 1]]:
                out[s] = f"{code:0{n}b}"
                code += 1
            at += codes[n - 1]
            code <<= 1
        return out

    dc, ac, bits, last = canonical(dc_codes), canonical(ac_codes), "", {}
    amplitude = lambda v, size: f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else ""
    for _ in range(6):
        for c in (0, 0, 0, 0, 1, 2):
            diff = int(rng.integers(-7, 8))
            last[c] = last.get(c, 0) + diff
            size = abs(diff).bit_length()
            bits += dc[size] + amplitude(diff, size)
            k = 1
            for s in rng.choice([0x01, 0x02, 0x12, 0xF0, 0x31], rng.integers(0, 9)):
                s = int(s)
                if k + (s >> 4) + 1 > 62:
                    break
                k += (s >> 4) + 1
                if s & 15:
                    v = int(rng.integers(1 << ((s & 15) - 1), 1 << (s & 15))) * int(rng.choice([-1, 1]))
                    bits += ac[s] + amplitude(v, s & 15)
                else:
                    bits += ac[s]
            bits += ac[0]
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    frame = struct.pack(">BHHB", 8, 20, 45, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    part = jpeg_media.segment
    return b"\xff\xd8" + part(0xE0, b"JFIF\0") + part(0xDB, b"\0" + bytes(range(3, 67))) + part(0xC0, frame) + part(0xC4, b"\0" + dc_codes) + part(0xC4, b"\x10" + ac_codes) + part(0xDA, b"\x03\x01\0\x02\0\x03\0\0\x3f\0") + scan + b"\xff\xd9"


def test_reader_decodes_other_writers_files():
    rng = np.random.default_rng(2)
    for _ in range(20):
        data = foreign_file(rng)
        media = jpeg_media.read([data])[0]
        assert isinstance(media, jpeg_media.Media), media
        assert media.coefficients.reshape(-1, 64).tolist() == slow_decode(data)
        assert (media.width, media.height) == (45, 20) and media.thumbnail.shape == (3, 6)
        assert media.thumbnail[0, 2] == np.clip(np.rint(media.coefficients[1, 0, 0] * 3 / 8 + 128), 0, 255)


def test_broken_media(spark):
    good = jpeg_media.write([bytes(range(192))])[0]
    progressive = good.replace(b"\xff\xc0", b"\xff\xc2", 1)
    rows = [(1, good), (2, good[:-40]), (3, b""), (4, None), (5, progressive), (6, good[:60]), (7, good)]
    out = {r.id: r for r in jpeg_media.media_columns(spark.createDataFrame(rows, "id int, media binary"), "id", "media").collect()}
    assert out[1].width == 8 and out[1].reason is None and out[1].feature == out[7].feature and len(out[1].thumbnail) == 1
    assert all(out[i].reason and out[i].width is None for i in (2, 3, 4, 5, 6))


def test_media_query(spark, odd, empty):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in jpeg_media.op8_jpeg_media(spark, SMALL).collect():
        payload = jpeg_media.payload(text[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text[r.doc_id].encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    rows = jpeg_media.store_texts(odd).collect()
    assert len(rows) == 9 and {r.payload_bytes for r in rows if r.doc_id in (1, 2)} == {192} and len({r.media_sha256 for r in rows if r.doc_id == 5}) == 1
    assert jpeg_media.store_texts(empty).count() == 0


def test_stages_keep_clashing_columns(spark, odd, empty):
    for stage in (toxicity.toxicity_stage, language_id.language_stage):
        for rows in (odd, empty):
            named = rows.withColumnsRenamed({"ids": "lang_pred", "tokens": "rejected", "source": "row"})
            out = stage(spark, named, LARGER)
            assert out.columns == named.columns and out.dtypes == named.dtypes
            assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in named.collect()}


def test_letters(spark):
    rows = spark.createDataFrame([("Ab-Cd 1é!",), (None,), ("42",)], "t string").select(letters_only(F.col("t"))).collect()
    assert [r[0] for r in rows] == [" ab cd é ", "", ""]
