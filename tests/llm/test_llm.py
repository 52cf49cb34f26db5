"""Operators of the corpus subpackage against plain versions, on small tables with every odd case."""

import collections
import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from racebook.llm import binary, bpe, chat, jaccard, langid, packing, quality, suffix, tokens, topk, warc
from racebook.llm.common import TIDY, drop_stored, ship, stored

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id LONG, text STRING, lang STRING, n LONG, start LONG, score DOUBLE"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def prose(rng, n, vocabulary=40):
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 7))) for _ in range(vocabulary)]
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def odd_texts():
    """Nulls, empty texts, copies, near copies, shared passages, one long text, signs beyond ASCII."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 220), 4000) for _ in range(30)]
    shared = prose(rng, 60, 4000)
    near = base[3].split()
    near[len(near) // 2] = "other"
    texts = [*base, None, "", " \n\t ", "one", "one two", base[0], base[0], " ".join(near), shared + base[1], base[2] + " " + shared]
    texts += ["Ünï cödé 日本語 🙂 ½ \x1c\x85 x's ABC!!  don't\n\n" * 9, prose(rng, 6000, 300), "ab" * 300, "<|endoftext|> a"]
    texts += [" ".join(f"{w}{i % 3}" if i % 17 == k else w for i, w in enumerate(base[5].split() + base[6].split())) for k in range(6)]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 1, 2, 0.5) for i, t in enumerate(odd_texts())]
    rows += [(None, "a text without an id " * 12, None, 1, 1, 1.0), rows[0], rows[0]]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def reference_ids(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_token_files_hold_every_document_in_order(docs, empty):
    got = binary.read_binary(binary.write_binary(docs, WORDS, 1)).collect()
    want = sorted(((r.doc_id is not None, r.doc_id or 0, (r.text or "").encode(), r.doc_id, reference_ids(r.text) + [1]) for r in docs.collect()), key=lambda x: x[:3])
    got.sort(key=lambda r: r.start)
    assert [(r.doc_id, r.n_tokens) for r in got] == [(w[3], len(w[4])) for w in want]
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(w[4], "<u4").tobytes()) for w in want]
    assert [r.start for r in got] == list(np.cumsum([0, *(r.n_tokens for r in got)])[:-1])
    assert binary.read_binary(binary.write_binary(empty, WORDS, 1)).count() == 0


def test_pieces_cover_every_document_once(docs, empty):
    got = packing.pack(docs, WORDS, 2).collect()
    assert packing.pack(empty, WORDS, 2).count() == 0
    assert sum(p.length for p in got) == sum(len(reference_ids(r.text)) + 1 for r in docs.collect())
    sequences = collections.defaultdict(list)
    for p in got:
        assert len(p.ids) == 4 * p.length > 0
        sequences[p.sequence_id].append((p.offset, p.length))
    padding = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.SIZE
        padding += 0 if end & (end - 1) == 0 else packing.SIZE - end
    assert padding <= 0.05 * sum(p.length for p in got)
    single = [d for d in docs.collect() if d.doc_id == 7][0]
    own = sorted((p.start, p.ids) for p in got if p.doc_id == 7)
    assert b"".join(x for _, x in own) == np.array(reference_ids(single.text) + [2], "<u4").tobytes()


def test_words_of_a_block_are_looked_up_once():
    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

    encoder = tokens.WordEncoder(WORDS)
    texts = [b"the sea, the Sea and\x0bthe\x1csea" * 1000, None, b"", b" \t\n", b"  sea\xc2\xa0the \xc2\x85 sea\r\n", b"the"]
    want = [b"".join(encoder._ids([w.decode() for w in (t or b"").split()])[k].tobytes() for k in range(len((t or b"").split()))) if t and t.strip() else b"" for t in texts]
    encoder.memo = Counted()
    assert encoder.encode(texts) == want
    assert Counted.asked < 60  # 6,008 words, few of them different
    assert encoder.encode([None]) == [b""] and encoder.encode([]) == []


def test_forms_of_a_word_are_learned_once():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    encoder = tokens.WordEncoder(WORDS)
    texts = ["Sea (sea) SEA, sea; Öl öl. \"ÖL\" sea2 2sea sea-öl", "We're we'Re 'tis 's'S 5's x.'s a|b", "Ÿ ÷ × J\u030c j\u030c T\u05b0\u0308. \u212a. İ \x00a½b"]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode([t.encode() for t in texts[:1]]) == want[:1]
    assert set(encoder.memo) == {x.encode() for x in ("", "sea", "öl", "2", "(", ")", '"', ",", ";", ".", "-")}
    assert encoder.encode([t.encode() for t in texts]) == want
    broken = [b"\xc3", b"\x84.", b"\xe2\xc3\x84.J\xcc", b"\xf0\x9f1\xc3'S"]
    assert encoder.encode(broken) == [np.array(library.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes() for t in broken]


def test_strings_of_added_tokens(spark):
    import corpus_pipeline
    from racebook.llm import plans
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    texts = ["hello <|endoftext|> world", "hello<|startoftext|>It's<|endoftext|><|endoftext|>", "hello <|ENDOFTEXT|> world", "plain words", "", None, "Ünï <|endoftext|>\n 日本"]
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert want[0] == [3306, 49407, 1002]
    docs = spark.createDataFrame([(i, t, "en", 1, 2, 0.5) for i, t in enumerate(texts)], DOCS)
    files = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in plans.op6_token_files(docs).collect()}
    assert files == {i: (len(x) + 1, zlib.crc32(np.array([*x, 1], "<u4").tobytes())) for i, x in want.items()}
    for packed in (plans.op2_packing(docs), corpus_pipeline.packed(spark, docs, "")):
        assert {r.doc_id: r.doc_tokens for r in packed.collect()} == {i: len(x) + 1 for i, x in want.items()}


def test_cuts_cost_least():
    rng = random.Random(3)
    for _ in range(60):
        at = np.array(sorted({0, *rng.sample(range(1, 60), rng.randint(1, 14))}))
        gap = int(np.diff(at).max())
        size = 1 << max(3, (gap - 1).bit_length())
        price = np.array([rng.choice([0, 3, 9]) for _ in at])
        best = [0] + [None] * (len(at) - 1)
        pad = lambda n: 0 if n & (n - 1) == 0 else size - n
        for j in range(1, len(at)):
            best[j] = min(best[i] + pad(int(at[j] - at[i])) for i in range(j) if at[j] - at[i] <= size) + price[j] + packing.OVERHEAD
        cuts = packing.choose_cuts(at, price, size).tolist()
        cost = sum(pad(b - a) + price[at.tolist().index(b)] + packing.OVERHEAD for a, b in zip(cuts, cuts[1:], strict=False))
        assert cost == best[-1] and cuts[0] == 0 and cuts[-1] == at[-1]


def test_bpe_equals_the_rank_library(docs, empty):
    import tiktoken

    ranks = bpe.load_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()}
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        own = got[r.doc_id]
        assert (own.n_tokens, own.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert own.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    back = bpe.decoded(bpe.encoded(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert sorted((r.doc_id or -1, r.text) for r in back.collect()) == sorted((r.doc_id or -1, r.text or "") for r in docs.collect())


def test_transducer_on_random_bytes():
    ranks, rng = bpe.load_ranks(RANKS), random.Random(4)

    def merged(text):
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    machine = bpe.Transducer(ranks)
    for _ in range(3000):
        text = bytes(rng.choice(b"aethino rs\xc3\xa9\xe6\x97\xa5\xff") for _ in range(rng.randint(1, 25)))
        assert machine.tokens(text) == merged(text)
    stream = bpe.Utf8Stream()
    raw = "aé日🙂".encode() * 3
    assert "".join([*(stream.push(raw[i : i + 1]) for i in range(len(raw))), stream.end()]) == raw.decode()


def test_quality_counts_and_verdicts(docs, empty, spark):
    space, symbols = r"[^\x20\x09-\x0D]+", "#*$%&|<>"
    rows = {r.doc_id: r for r in quality.judged(quality.with_counts(docs)).collect()}
    for r in docs.collect():
        text, own = r.text or "", rows[r.doc_id]
        words = re.findall(space, text)
        windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(space, x)]
        want = [len(words), sum(map(len, words)), sum(c in symbols for c in text), len(lines) - len(set(lines)), len(again)]
        assert [own[quality.OWN + c] for c in quality.COUNTS[:5]] == want
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        assert own[quality.OWN + "base_failed"] == failed and not (failed and own[quality.OWN + "kept"])
    assert quality.kept_rows(empty).count() == 0
    assert quality.kept_rows(docs).columns == docs.columns


def test_rules_learn_from_votes_alone():
    rng = np.random.default_rng(1)
    good = rng.random(4000) < 0.8
    votes = np.where(good[:, None], rng.choice([1, 0, -1], (4000, 6), p=[0.8, 0.197, 0.003]), rng.choice([1, 0, -1], (4000, 6), p=[0.3, 0.2, 0.5]))
    patterns, weights = np.unique(votes, axis=0, return_counts=True)
    prior, odds = quality.fit(patterns, weights.astype("f8"))
    score = prior + sum(odds[j][votes[:, j] + 1] for j in range(6))
    assert ((score > 0) == good).mean() > 0.97
    assert quality.fit(np.zeros((0, 6), "i8"), np.zeros(0))[0] == 0


def shingles(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


@pytest.mark.parametrize("k,percent,tile", [(3, 90, jaccard.TILE), (5, 80, jaccard.TILE), (3, 90, 700), (5, 80, 2000)])
def test_jaccard_groups_equal_all_pairs(docs, empty, spark, monkeypatch, k, percent, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)  # a small one parts clusters into many blocks
    rng = random.Random(8)
    family = prose(rng, 120, 3000).split()
    copies = [" ".join(rng.choice(["new", "word"]) + str(rng.random()) if rng.random() < 0.015 else w for w in family) for _ in range(90)]
    table = docs.unionByName(spark.createDataFrame([(1000 + i, c, "", 1, 1, 0.0) for i, c in enumerate(copies)], DOCS))
    sets = {r.doc_id: shingles(r.text, k) for r in table.collect() if r.doc_id is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r for r in jaccard.jaccard_groups(table, k, percent).collect()}
    assert {i: (got[i].n_shingles, got[i].component_id) for i in ids} == {i: (len(sets[i]), find(i)) for i in ids}
    assert len({find(1000 + i) for i in range(90)}) < 90
    assert jaccard.jaccard_groups(empty, k, percent).count() == 0


@pytest.mark.parametrize("k,percent", [(5, 80), (3, 90), (2, 67)])
def test_small_sets_keep_their_links_where_all_shingles_are_low_and_rare(spark, k, percent):
    rng, shingler = random.Random(31), jaccard.Shingler(k)

    def low(before, after):  # a word that makes only shingles of the lowest quarter
        while True:
            word = f"w{rng.random():.9f}"
            made = shingler.sets([" ".join([*before[-k + 1 :], word, *after[: k - 1]]).encode()])[0]
            if len(before) + len(after) < k - 1 or made.max() < jaccard.LOW:
                return word

    texts = []
    for n in [k + 3 + i % 6 for i in range(60)]:
        words = []
        for _ in range(n):
            words.append(low(words, []))
        texts += [" ".join(words), " ".join([*words, low(words, [])]), " ".join([low([], words), *words])]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    sets = [shingles(t, k) for t in texts]
    want = {}
    for g in range(0, len(sets), 3):  # other triples share nothing
        linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
        links = {(a, b) for a in range(g, g + 3) for b in range(a + 1, g + 3) if linked(a, b)}
        want[g] = g
        want[g + 1] = g if (g, g + 1) in links or {(g, g + 2), (g + 1, g + 2)} <= links else g + 1
        want[g + 2] = g if (g, g + 2) in links or {(g, g + 1), (g + 1, g + 2)} <= links else g + 1 if (g + 1, g + 2) in links else g + 2
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(table, k, percent).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_a_line_that_many_texts_hold_makes_no_product_of_their_cluster(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 2000)
    rng, tiles, plain = random.Random(77), [], jaccard.tiled_links

    def counting(docs, dealt, words, percent, diagonal):
        tiles.append(dealt.agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0] or 0)
        return plain(docs, dealt, words, percent, diagonal)

    monkeypatch.setattr(jaccard, "tiled_links", counting)
    line = prose(rng, 60, 4000)
    texts = [prose(rng, 30, 4000) + " " + line for _ in range(150)]
    texts += [texts[7] + " more", texts[9] + " words", texts[9] + " words here"]
    table = spark.createDataFrame([*enumerate(texts), (9, None), (7, "one")], "doc_id LONG, text STRING")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(table, 3, 90).where("n_shingles > 1").collect()}
    assert got == {i: i for i in range(150)} | {150: 7, 151: 9, 152: 9}
    assert sum(tiles) < 30  # the texts that have links; 153 texts in seven blocks, each against all, before


def test_texts_of_takes_the_rows_of_the_ids_alone(spark):
    table = spark.createDataFrame([(i % 50 - 20 or None, f"t{i}") for i in range(100)], "doc_id LONG, text STRING")
    few = spark.createDataFrame([(-20, 1), (-20, 2), (0, 3), (7, 4), (99, 5)], "doc_id LONG, cluster LONG")
    want = sorted((i % 50 - 20, f"t{i}", c) for i in range(100) for k, c in ((-20, 1), (-20, 2), (7, 4)) if i % 50 - 20 == k)
    assert sorted(map(tuple, jaccard.texts_of(table, few).select("doc_id", "text", "cluster").collect())) == want
    assert jaccard.texts_of(table, few.limit(0)).count() == 0


def test_repeated_bytes_equal_a_plain_scan(docs, empty, monkeypatch):
    seen, want = set(), []
    rows = sorted((((r.doc_id is None, r.doc_id or 0), (r.text or "").encode()) for r in docs.collect()))
    for key, text in rows:
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - suffix.LENGTH + 1):
            part = text[i : i + suffix.LENGTH]
            if part in seen:
                gone[i : i + suffix.LENGTH] = True
            seen.add(part)
        spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        want.append((key[1] if not key[0] else None, len(text), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(text, "u1")[~gone].tobytes()).hexdigest()))
    for shard in (1 << 14, 1 << 22):
        monkeypatch.setattr(suffix, "SHARD", shard)
        out = suffix.without_repeats(docs, digest=True).collect()
        o = suffix.OWN
        got = [(r.doc_id, r[o + "n_bytes"], r[o + "n_removed"], r[o + "n_spans"], r[o + "kept"]) for r in out]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert suffix.without_repeats(empty).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = random.Random(6)
    data = bytes(rng.choice(b"ab") for _ in range(400)) + b"x" * 350 + bytes(rng.choice(b"ab") for _ in range(300))
    data += data[:500]
    words = suffix.words_at(np.frombuffer(data, "u1"))
    starts = np.arange(len(data) - suffix.LENGTH + 1)
    order = suffix.suffix_array(words, starts).tolist()
    assert order == sorted(starts.tolist(), key=lambda i: (data[i : i + suffix.LENGTH], i))
    shared = suffix.common_prefixes(words, np.array(order)).tolist()
    for a, b, n in zip(order, order[1:], shared[1:], strict=False):
        plain = next((k for k in range(suffix.LENGTH) if data[a + k] != data[b + k]), suffix.LENGTH)
        assert n == plain


def test_hot_marks_are_dealt_on(docs, monkeypatch):
    monkeypatch.setattr(suffix, "SHARD", 1 << 14)
    want = sorted(map(str, suffix.without_repeats(docs.select("doc_id", "text"), digest=True).collect()))
    keys = np.array([5, 5, 5], "i8")
    part = bytes(range(100, 230))
    assert suffix.merged_cover(keys, np.array([2, 0, 1]), [part, part[:110], part[5:]]) == [(0, 0, 30), (2, 0, 5)]
    assert sorted(map(str, suffix.without_repeats(docs.select("doc_id", "text"), digest=True).collect())) == want


def test_language_of_mixed_text(spark, empty):
    rng = random.Random(9)
    parts = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["sch", "ung", "ein", "pf"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3)))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    rows = [(i, text(lang, 80), lang, 1, 1, 0.0) for i in range(80) for lang in [("xx", "yy")[i % 2]]]
    rows += [(200, None, "xx", 1, 1, 0.0), (201, "123 !!", "xx", 1, 1, 0.0), (202, "", None, 1, 1, 0.0), (203, text("xx", 3000) + " " + text("yy", 900), None, 1, 1, 0.0)]
    docs = spark.createDataFrame(rows, DOCS)
    field = langid.learned(docs, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in langid.labelled(docs, field).collect()}
    assert sum(got[i].lang_pred == ("xx", "yy")[i % 2] for i in range(0, 80, 5)) >= 15
    assert [got[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3 and got[200].score == 0
    assert got[203].lang_pred == "xx" and got[203].score == pytest.approx(3000 / 3900, abs=0.03)
    assert langid.labelled(empty, field).count() == 0
    assert {r.lang_pred for r in langid.labelled(docs, langid.learned(empty, F.lit(True))).collect()} == {"und"}


def test_language_inside_long_runs(spark):
    rng = random.Random(4)
    letters = {"aa": "天地玄黃宇宙洪荒日月", "bb": "あいうえおかきくけこ"}
    run = lambda lang, n: "".join(rng.choice(letters[lang]) for _ in range(n))
    rows = [(i, run(lang, 300), lang, 1, 1, 0.0) for i in range(60) for lang in [("aa", "bb")[i % 2]]]
    rows += [(100, run("aa", 6) + run("bb", 900) + run("aa", 6), None, 1, 1, 0.0), (101, run("aa", 600) + run("bb", 300), None, 1, 1, 0.0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in langid.labelled(docs, langid.learned(docs, F.col("doc_id") % 5 != 0)).collect()}
    assert all(got[i].lang_pred == ("aa", "bb")[i % 2] for i in range(0, 60, 5))
    assert got[100].lang_pred == "bb" and got[100].score > 0.9
    assert got[101].lang_pred == "aa" and got[101].score == pytest.approx(2 / 3, abs=0.05)
    for word in ("é日🙂a" * 40, "Ⱥ" * 50, "a" * 200):
        cut = langid.pieces([b"x", word.encode(), b"\x80" * 90])
        assert b"".join(cut) == b"x" + word.encode() + b"\x80" * 90 and max(map(len, cut)) <= langid.LONG
        assert "".join(c.decode() for c in cut[1:] if c[0] != 0x80) == word
        assert langid.table_of([langid.plain(c) for c in cut]).shape[0] == len(cut)


def test_language_sample_of_shared_ids(spark, monkeypatch):
    import corpus_pipeline

    rng = random.Random(6)
    rows = [(None, prose(rng, 40), "aa", 1, 1, 0.0) for _ in range(400)] + [(7, "日" * 30000 + str(i), "bb", 1, 1, 0.0) for i in range(400)]
    rows += [(None, "the same text again", "cc", 1, 1, 0.0)] * 400
    docs = spark.createDataFrame(rows, DOCS)
    taken = []
    monkeypatch.setattr(langid, "train", taken.extend)
    langid.learned(docs, F.lit(True), rows_each=40)
    sizes = collections.Counter(lang for lang, _ in taken)
    assert 15 <= sizes["aa"] <= 80 and 15 <= sizes["bb"] <= 80 and sizes["cc"] == 1
    assert max(sum(map(len, words)) for _, words in taken) <= langid.CHARACTERS
    monkeypatch.undo()
    kept = corpus_pipeline.language(spark, docs.withColumn("lang", F.lit(None).cast("string")).unionByName(spark.createDataFrame([(1, "12 !", None, 1, 1, 0.0)], DOCS)), "")
    assert kept.count() == len(rows)


def test_stretches_carry_chances_exactly():
    rng = np.random.default_rng(2)
    lengths = np.array([0, 1, 300, 129, 128, 5])
    emitted = rng.random((lengths.sum(), 3)).astype("f4") + 1e-3
    transitions = rng.normal(size=(3, 3))
    got, at, moves = langid.chances(emitted, lengths, transitions), 0, np.exp(transitions)
    for n in lengths.tolist():
        e = emitted[at : at + n].astype("f8")
        ahead, behind, state = np.zeros((n, 3)), np.ones((n, 3)), np.full(3, 1 / 3)
        for i in range(n):
            state = (state @ moves) * e[i]
            ahead[i] = state = state / state.sum()
        for i in range(n - 2, -1, -1):
            behind[i] = moves @ (e[i + 1] * behind[i + 1])
            behind[i] /= behind[i].sum()
        plain = ahead * behind
        assert np.allclose(got[at : at + n], plain / plain.sum(1, keepdims=True))
        at += n


def test_archives_give_back_pages(spark):
    rng = random.Random(2)
    rows = [(i, f"http://a/{i % 7} é", prose(rng, rng.randint(0, 300))) for i in range(60)]
    rows += [(100, None, rows[3][2]), (101, "u", rows[3][2]), (102, "u\r\nX: y", None), (103, "u", ""), (104, "u", "é" * 70000), (None, "u", rows[5][2]), rows[9], rows[9]]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING").withColumn("payload", F.lit(1))
    got = warc.read_warc(warc.write_warc(pages, roll_bytes=1 << 13)).collect()
    first = {}
    for key, _, html in rows:
        first[html or ""] = min([k for k in (first.get(html or ""), key) if k is not None], default=None)
    want = []
    for key, _, html in rows:
        raw, own = (html or "").encode(), first[html or ""]
        want.append((key, len(raw), warc.digest(raw), "response" if key == own else "revisit", None if key == own else own))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    assert all(r.payload.decode() == dict((k, h or "") for k, _, h in rows)[r.page_id] for r in got if r.record_type == "response")
    again = warc.write_warc(pages, roll_bytes=1 << 13)
    assert again.select("sha256").distinct().count() == again.count() > 1
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0


def test_search_equals_all_scores(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-9, 9, 12) / 16).tolist()) for i in range(300)]
    rows += [(400, None), (420, [float("nan")] * 12), (440, [None, 1.0]), (460, []), (480, [1.0, 2.0]), (500, rows[0][1]), (None, [1.0]), (40, rows[40][1])]
    table = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>").withColumn("rank", F.lit(7))
    kept = [(i, np.floor(np.array(v) * 64).astype("i8")) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, a in kept:
        if q % 20 == 0:
            scores = sorted((-int((a[: len(b)] * b[: len(a)]).sum()), i) for i, b in kept if i != q)[:20]
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)}
    got = topk.search(table, F.col("vec_id") % 20 == 0)
    by_query = {(r.query_id, r.vec_id, r.score) for r in got.filter("query_id <> 40").collect()}
    assert by_query == {(q, i, s) for q, _, i, s in want if q != 40}
    assert topk.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_snapshots_collapse(spark):
    say = lambda c, turns: [(c, t, r, x) for t, (r, x) in enumerate(turns)]
    full = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", None)]
    rows = say(1, full[:2]) + say(2, full) + say(3, full) + say(4, [("user", "a"), ("assistant", "x")]) + say(5, [("user", "a")])
    rows += say(6, [("user", "z")] * 700) + say(7, [("user", "z")] * 300) + [rows[0], (8, None, "user", "n"), (None, 0, None, ""), (9, 0, "user", "p"), (9, 0, "user", "o")]
    logs = spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING").withColumn("part", F.lit(3))
    got = {r.conv_id: (r.n_turns, r.copies) for r in chat.maximal(logs).collect()}
    assert got == {2: (4, 2), 4: (2, 1), 6: (700, 1), 8: (1, 1), None: (1, 1), 9: (2, 1)}
    texts = {(r.conv_id, r.part): r.text for r in chat.render(logs).collect()}
    assert texts[2, 0] == "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n<|user|>\nc<|end|>\n<|assistant|>\n<|end|>\n"
    assert texts[9, 0] == "<|user|>\no<|end|>\n<|user|>\np<|end|>\n" and texts[None, 0] == "<|unknown|>\n<|end|>\n"
    assert len([k for k in texts if k[0] == 6]) == 11
    assert chat.render(logs.limit(0)).count() == 0
    plan = chat.render(logs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_crowded_turn_comes_in_bounded_parts(spark):
    import duckdb

    from racebook.llm import plans

    ids = spark.range(100_000)
    hot = ids.select(F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.when(F.col("id") % 3 > 0, "user").alias("role"), F.concat(F.lit("é "), F.col("id").cast("string")).alias("text"))
    few = spark.range(200).select(F.lit(5).cast("long").alias("conv_id"), (F.col("id") % 2).alias("turn"), F.lit("user"), F.col("id").cast("string"))
    logs = hot.union(few).union(few.limit(3)).union(spark.sql("SELECT 5L, 1L, 'bot', NULL"))
    got = {(r.conv_id, r.part): r for r in chat.render(logs).collect()}
    counts = [r.text.count("<|end|>") for r in got.values()]
    assert max(counts) == chat.PART and sum(counts) == 100_201
    assert sum(r.conv_id is None for r in got.values()) == -(-100_000 // chat.PART)
    logs = hot.where("length(text) < 6").union(few).union(spark.sql("SELECT 5L, 1L, 'bot', NULL"))
    got = {(r.conv_id, r.part): r for r in chat.render(logs).collect()}
    con = duckdb.connect()
    con.register("conversations", logs.toArrow())
    want = con.execute(plans.ORACLES["op7_chat"]).fetchall()
    assert {(c, p): (n, k, x) for c, p, n, k, x in want} == {k: (r.n_turns, r.copies, r.text) for k, r in got.items()}


def test_pipeline_stages_on_odd_rows(spark, docs):
    import corpus_pipeline

    table = docs.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    out = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in out.select("doc_id").collect()}
        out = spark.createDataFrame(stage(spark, out, "").collect(), table.schema)
        assert out.columns == table.columns
        assert {r.doc_id for r in out.select("doc_id").collect()} <= before, name
        for r in out.collect():
            assert r.n_chars == len(r.text)
    seen = set()
    for r in sorted((r for r in out.collect() if r.doc_id is not None), key=lambda r: r.doc_id):
        words = (r.text or "").split()
        assert len(words) > 0
        seen.add(r.doc_id)
    assert 35 not in seen and 36 not in seen  # copies of document 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, out, "").collect()
    assert sum(p.length for p in pieces) == sum(len(reference_ids(r.text)) + 1 for r in out.collect())


def test_registered_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def test_texts_without_a_letter_have_no_language(spark):
    """Circled letters, number signs and combining marks are no letters, though some have small and large forms."""
    rng = random.Random(7)
    rows = [(i, prose(rng, 30), "aa" if i % 2 else "bb", 1, 1, 0.0) for i in range(1, 200)]
    odd = ["ⓐ ⓑ", "Ⅷ ⅷ", "ͅ", "12 !", "", None, " \n"]
    docs = spark.createDataFrame(rows + [(1000 + i, t, None, 1, 1, 0.0) for i, t in enumerate(odd)], DOCS)
    field = langid.learned(docs, F.lit(True))
    got = {r.doc_id: r.lang_pred for r in langid.labelled(docs, field).collect()}
    assert all(got[1000 + i] == langid.UNKNOWN for i in range(len(odd))) and got[1] in ("aa", "bb")


def test_equal_strings_by_runs():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 2, 3000).astype("u1")
    data[1500:2200] = data[100:800]
    left = np.sort(rng.choice(2800, 900, replace=False))
    right = np.where(rng.random(900) < 0.3, rng.integers(0, 2800, 900), np.minimum(left + 1400, 2890))
    want = [bytes(data[a : a + suffix.LENGTH]) == bytes(data[b : b + suffix.LENGTH]) for a, b in zip(left, right)]
    for block in (1, 300, 1 << 20):
        suffix.BLOCK, before = block, suffix.BLOCK
        assert suffix.same_strings(data, left, right).tolist() == want and any(want)
        suffix.BLOCK = before


def test_a_stored_table_leaves_no_shuffle_behind(spark):
    folders = [str(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    held = lambda: {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before, set_to = held(), spark.conf.get(TIDY)
    rows = spark.range(20_000).select((F.col("id") % 9973).alias("k"), F.xxhash64("id").alias("v"))
    table = stored(rows.groupBy("k").agg(F.max("v").alias("most")).join(rows, "k").repartition(5, "v"), "tidy")
    for _ in range(100):  # files go in the background
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before and spark.conf.get(TIDY) == set_to
    assert table.count() > 0
    drop_stored(table)
