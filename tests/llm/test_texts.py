"""Decontamination, personal data, language, tokens, records, shards and the pipeline."""

import gc
import hashlib
import itertools
import math
import random
import re
import struct
import tracemalloc
import weakref
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

import corpus_pipeline
from earshot.llm import contamination, language, memo, pieces, pii, sharding, shingles, tokenfiles, warc

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, ids int, spans string, n_words int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "x", 2) for i, t in rows], SCHEMA)


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "plain"), (4, "plain"), (None, "no id"), (6, "naïve ＡＢ 世界 🙂 ﷺ\x1cé" * 3),
    (7, "long " * 30_000), (8, "'s it's 12 a_b -- <|endoftext|>"),
]


# Contamination.


def brute_contamination(text, items):
    def split(x):
        fold = (x or "").translate({c: c + 32 for c in range(65, 91)})
        return [(m[0], m.span()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold)]

    found = split(text)
    flat = [w for w, _ in found]
    hit, names = set(), set()
    for name, item in items:
        parts = [w for w, _ in split(item)]
        for at in range(max(1, len(parts) - 12)) if parts else ():
            part = parts[at:at + 13]
            for k in range(len(flat) - len(part) + 1):
                if flat[k:k + len(part)] == part:
                    hit |= set(range(k, k + len(part)))
                    names.add(name)
    chars = {c for k in hit for c in range(*found[k][1])}
    return len(flat), len(hit), sorted(names), chars


@pytest.mark.parametrize("block, stretch, common", [(4 << 20, 1 << 18, 128), (200, 7, 2), (4 << 20, 50, 0)])
def test_contamination(spark, monkeypatch, block, stretch, common):
    monkeypatch.setattr(contamination, "BLOCK_BYTES", block)
    # The tasks' module is another one than ours.
    for text in ("é1 x1 a b the don", "b " * 40 + "é1 x1 a b the don a", "x" * 300 + " a b zebra"):
        monkeypatch.setattr(contamination, "STRETCH", stretch)
        monkeypatch.setattr(contamination, "COMMON", common)
        items = [("1", "é1 x1 a"), ("2", "b b " * 7), ("3", "zebra"), ("4", "don a q"), ("5", "x1"), ("6", "the é1 " * 9)]
        windows = contamination.Windows([(k, t.encode()) for k, t in items])
        n, runs, names = contamination.scan(windows, text.encode())
        want = brute_contamination(text, items)
        assert (n, sum(b - a + 1 for a, b in runs), sorted(names)) == want[:3]
    rng = random.Random(1)
    vocabulary = ["the", "Été", "x1", "don", "a", "b"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate((14, 20, 13, 3, 1, 40))]
    items += [(7, None), (8, " .,; "), (9, items[2][1].upper()), (None, "zebra")]
    rows = list(ODD)
    for i in range(20, 60):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        item = rng.choice(items)[1] or ""
        rows.append((i, "; ".join(text) + ". " + item.replace(" ", ", ") + " 'q' " + "-".join(text[:5])))
    found = contamination.contamination(
        table(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    names = [("" if k is None else str(k), t) for k, t in items]
    want = {r[1]: brute_contamination(r[1], names) for r in rows}
    assert len(found) == len(rows)
    for r in found:
        n, hit, owners, chars = want[r.text]
        assert (r.n_words, r.n_hit, r.hit_items, r.lang) == (n, hit, owners, "en"), r.text
        covered = {c for s in r.hit_spans for c in range(s.start, s.end)}
        assert chars <= covered
        assert all(r.text[s.start].isalnum() and r.text[s.end - 1].isalnum() for s in r.hit_spans)
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination.contamination(table(spark, [(1, "a b")]), none).first().n_hit == 0
    assert contamination.contamination(table(spark, []), none).count() == 0


def test_contamination_takes_bounded_memory_for_items_and_long_texts():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(20_000)]
    # Word frequencies as in texts, the k-th word about 1 / k.
    weights = [1 / (k + 1) for k in range(len(words))]
    items = [(str(k), " ".join(rng.choices(words, weights, k=100)).encode()) for k in range(2_200)]
    assert 1_000_000 < sum(len(t) for _, t in items)
    windows = contamination.Windows(items)
    assert windows.automaton.get_stats()["total_size"] < 125_000_000
    text = b" ".join(t for _, t in items[:500])
    tracemalloc.start()
    n, runs, names = contamination.scan(windows, text * 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 500 * 100 * 5 - 4 and len(runs) == 1 or len(names) == 500
    assert peak < 40_000_000


# Personal data.


def base_spans(text):
    """The four patterns as stated, by the regex engine alone."""
    patterns = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]
    out = []
    for kind, pattern in patterns:
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit() and c.isascii()]
            luhn = sum(sum(divmod(d * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
            ok = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_plain_spans_are_those_of_the_patterns():
    rng = random.Random(7)
    bits = ["@", ".", "a", "b.c", "1", "12", "4111 1111 1111 1111", "+1", "(55)", "-", " ", "255", "256", "é", "x@y.z", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(25)))
        assert pii.plain(text) == base_spans(text), text


def test_plain_spans_take_time_in_proportion_to_the_text():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 150_000, "+1(" * 100_000, "a.b@c" * 60_000):
        pii.disguised(text, pii.plain(text))


@pytest.mark.parametrize("hidden, kind", [
    ("john (at) example [dot] com", "email"), ("john dot doe at ex dot co dot uk", "email"),
    ("jоhn@exаmple.com", "email"), ("joh​n@ex​ample.com", "email"), ("john＠example．com", "email"),
    ("one nine two dot one six eight dot one dot one", "ip"), ("１９２.１６８.１.１", "ip"),
    ("４１１１ １１１１ １１１１ １１１１", "card"), ("four one one one " * 3 + "four one one two", None),
    ("max (ät) beispiel (punkt) de", "email"), ("juan arroba ejemplo punto com", "email"), ("ann@mail。com", "email"),
    ("jean (arobase) exemple (point) fr", "email"), ("+33 un deux trois quatre cinq six sept huit neuf", "phone"),
    ("192.168.1.un", "ip"), ("un.deux.trois.quatre", "ip"),
    ("plus four nine one five one two three four five six seven", "phone"), ("+４９ 151 234 5678", "phone"),
])
def test_disguises(hidden, kind):
    for before, after in (("", ""), ("Write to ", ", please."), ("Ça: ", "\nnext")):
        text = before + hidden + after
        found = pii.disguised(text, pii.plain(text))
        want = [(kind, len(before), len(before) + len(hidden))] if kind else []
        assert [s for s in found if s[0] == kind or not kind] == want, found


@pytest.mark.parametrize("hidden, kind", [
    ("+1 415 five five five 0199", "phone"), ("plus 49 170 1234567", "phone"), ("PLUS 49 one seven 0 1234567", "phone"),
    ("4111 1111 1111 one one one 1", "card"), ("192.168.one.one", "ip"), ("10(.)0(.)0(.)1", "ip"),
    ("10.0.0.fıve", "ip"), ("10 punkt 0 punkt 0 punkt eins", "ip"),
    ("john at example [dot] museum", "email"), ("john at example(.)museum", "email"),
    ("john at mail dot example dot museum", "email"), ("john at example dot xyz", "email"),
])
def test_disguises_in_part(hidden, kind):
    for after in ("", ", one of us", " (at) x dot y one two three four"):
        text = f"Ça: {hidden}; that{after}"
        assert (kind, 4, 4 + len(hidden)) in pii.disguised(text, pii.plain(text)), text


def test_un_counts_as_a_digit_wherever_it_stands():
    for hidden, kind in (("+un un un un un un un un un", "phone"), ("+4(un)2345(un)789", "phone"), ("4un 0", None)):
        text = f"Tel. {hidden}; voilà"
        found = pii.disguised(text, pii.plain(text))
        assert found == ([(kind, 5, 5 + len(hidden))] if kind else []), text


def test_bare_at_before_prose_is_no_sign():
    for text in ("We met at this point in time.", "Wait at every dot you see.", "See it at West Point in May; one plus one is two."):
        assert pii.disguised(text, pii.plain(text)) == []


def test_parts_left_out_of_a_text_match_nothing_in_it():
    rng = random.Random(11)
    bits = [*pii._DIGIT_WORDS, "PLUS ", " dot ", "(", ".", ")", " at ", "[AT]", " ", "1", "fİve", "fıve", "x", "é", "com", "_", "-", "{ Punkt }"]
    for _ in range(4000):
        source = pii._letters(pii.Rewritten("".join(rng.choice(bits) for _ in range(rng.randrange(12)))))
        whole = pii._pattern(tuple(pii._DISGUISES)).finditer(source.text)
        kinds = pii._kinds(source.text)
        some = pii._pattern(kinds).finditer(source.text) if kinds else ()
        assert [(m.lastgroup, m.span()) for m in whole] == [(m.lastgroup, m.span()) for m in some], source.text


def test_clean_texts_have_no_disguised_spans():
    for text in ("Look at the dot on one of two maps.", "At example.com we met at two.", "one two three four five", "Ǆ ſeven İ fİve"):
        assert pii.disguised(text, pii.plain(text)) == []


def test_pii_table(spark):
    rows = [*ODD, (9, "a@b.co, a (at) b (dot) co"), (10, "jоhn@ex.com")]
    found = pii.find(table(spark, rows))
    got = {r.text: ([tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in found.collect()}
    assert found.count() == len(rows)
    assert got["a@b.co, a (at) b (dot) co"] == ([("email", 0, 6)], [("email", 0, 6), ("email", 8, 25)])
    assert got["jоhn@ex.com"] == ([("email", 2, 11)], [("email", 0, 11), ("email", 2, 11)])
    assert got[None] == ([], []) and pii.find(table(spark, [])).count() == 0


# Language.


def test_bundling_is_the_sum_of_bound_letters():
    def vector(word):
        total = np.zeros(language.DIMENSIONS)
        padded = f" {word.lower()} "
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            x, y, z = (language.letter_vector(ord(k)).astype(int) for k in (a, b, c))
            total += np.roll(x, 2) * np.roll(y, 1) * z
        return total

    texts = ["Été, 12 a-b", "", "x", "  ", "日本語 Ωmega"]
    want = [vector("été") + vector("a") + vector("b"), 0, vector("x"), 0, vector("日本語") + vector("ωmega")]
    assert all(np.array_equal(row, np.zeros(language.DIMENSIONS) + w) for row, w in zip(language.bundle(texts), want))


def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    aside = language.held_out(F.col("doc_id"))
    found = language.predict(docs, language.learn(docs.where(~aside))).where(aside)
    rows = found.select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows) > 20
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_cases(spark):
    rows = [*ODD, (11, "123 ..."), (12, "der die das")]
    model = language.learn(spark.createDataFrame(
        [("the of and to", "en"), ("der die das und", "de"), (None, "fr"), ("x", None)], "text string, lang string"
    ))
    assert sorted(model) == ["de", "en"]
    found = {r.text: (r.lang_pred, r.score) for r in language.predict(table(spark, rows), model).collect()}
    assert found["der die das"][0] == "de" and 0 < found["der die das"][1] <= 1
    assert {found[t] for t in (None, "", " \n\t ", "123 ...")} == {("und", 0.0)}
    assert language.predict(table(spark, rows), {}).where("lang_pred != 'und'").count() == 0
    assert language.learn(table(spark, [])) == {}


# Tokens.


def test_piece_ids_are_those_of_the_library(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += [t for _, t in ODD] + ["  a  b   c ", "aaaa " * 50, "abababab" * 40, "x" * 300, "▁▁x▁", "123456", "\u0000"]
    rows = list(enumerate(texts))
    found = pieces.decode(pieces.encode(table(spark, rows), PIECES), PIECES)
    for r in found.collect():
        text = texts[r.doc_id] or ""
        assert r.ids == library.encode(text)
        assert r.decoded == text.replace("▁", " ")
    assert found.columns == ["doc_id", "text", "lang", "spans", "n_words", "ids", "decoded"]
    assert pieces.encode(table(spark, []), PIECES).count() == 0


def test_unigram_search_is_that_of_the_library(tmp_path):
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PIECES, "rb").read())
    proto.trainer_spec.model_type = 1
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    held = pieces.Encoder(pieces.Pieces(str(path)))
    rng = random.Random(2)
    for _ in range(300):
        text = " ".join("".join(rng.choice("aeinrst,é世") for _ in range(rng.randrange(1, 12))) for _ in range(4))
        assert np.frombuffer(held.encode([text])[0], np.int32).tolist() == library.encode(text), text


def test_streams_commit_as_they_go():
    held = pieces.pieces_of(PIECES)
    text = "▁" + "the▁quick▁brown▁fox▁" * 400
    for size in (1, 7, 1000):
        stream = pieces.Stream(held)
        for at in range(0, len(text), size):
            stream.feed(text[at:at + size])
            assert len(stream.text) <= 12 * held.longest
        whole = pieces.Stream(held)
        whole.feed(text)
        assert stream.finish() == whole.finish()


def test_new_short_words_are_searched_together(monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(7)
    syllables = ["th", "ing", "tion", "an", "re", "e", "é", "ß", "世", "界", "🙂", "1", ".", ",", "\n", "\u0000", "a" * 9]
    words = ["".join(rng.choices(syllables, k=rng.randrange(1, 12))) for _ in range(20_000)]
    texts = [" ".join(w for w in words[i:i + 20] if len(w) < pieces.SHORT) for i in range(0, len(words), 20)]
    monkeypatch.setattr(pieces.Stream, "_extend", lambda *_: pytest.fail("one word by itself"))
    found = pieces.Encoder(pieces.pieces_of(PIECES)).encode(texts)
    assert [np.frombuffer(ids, np.int32).tolist() for ids in found] == library.encode(texts)


@pytest.mark.parametrize("model_type", [1, 2])
def test_lattices_side_by_side_are_those_of_streams(tmp_path, model_type):
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PIECES, "rb").read())
    proto.trainer_spec.model_type = model_type
    path = tmp_path / "pieces.model"
    path.write_bytes(proto.SerializeToString())
    held = pieces.Pieces(str(path))
    rng = random.Random(3)
    texts = ["".join(rng.choices("aeinrst▁▁▁,é世🙂", k=k)) for k in range(pieces.SHORT + 1) for _ in range(6)]
    encoder = pieces.Encoder(held)
    assert encoder.lattices.encode(texts) == [encoder._search(t) for t in texts]
    assert encoder.lattices.encode([]) == [] and encoder.lattices.encode(["", "a"])[0] == b""
    if held.merges:
        left, right = (np.array(rng.choices(list(held.ids.values()), k=5000)) for _ in range(2))
        want = [held.may_follow(a, b) for a, b in zip(left.tolist(), right.tolist())]
        for _ in range(2):
            assert encoder.lattices.may_follow(left, right).tolist() == want


def test_words_about_as_long_as_the_short_ones():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(5)
    texts = ["".join(rng.choices("aeinrst世é", [9] * 7 + [1, 1], k=k)) for k in range(pieces.SHORT - 3, pieces.SHORT + 4)]
    texts += [" ".join(texts), "世界" * 100 + " " + "thing" * 60 + " x"]
    found = pieces.Encoder(pieces.pieces_of(PIECES)).encode(texts)
    assert [np.frombuffer(ids, np.int32).tolist() for ids in found] == library.encode(texts)


def test_what_an_encoder_remembers_goes_with_it():
    encoder = pieces.Encoder(pieces.pieces_of(PIECES))
    encoder.encode(["some words " + "x" * 100])
    gone = weakref.ref(encoder)
    gc.disable()
    try:
        del encoder
        assert gone() is None
    finally:
        gc.enable()


def test_lookups_by_arrays_of_keys():
    rng = random.Random(1)
    table = {rng.randrange(1 << 40): rng.randrange(1 << 20) for _ in range(3000)}
    keys = [*table, *(rng.randrange(1 << 40) for _ in range(3000)), 0]
    assert pieces.Lookup(table)(np.array(keys)).tolist() == [table.get(k, -1) for k in keys]
    assert pieces.Lookup({})(np.array([0, 5])).tolist() == [-1, -1]


def test_token_files(spark, tmp_path):
    library = Tokenizer.from_file(WORDS)
    rows = [(10 * i, t) for i, (_, t) in enumerate(ODD)] + [(None, "no id"), (3, "word " * 40), (3, "word " * 40)]
    folder = f"file://{tmp_path}/files"
    written = tokenfiles.write(table(spark, rows), folder, WORDS)
    found = tokenfiles.read(folder, written).orderBy(F.asc_nulls_first("doc_id"), "start").collect()
    start = 0
    for r, (key, text) in zip(found, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (key, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    file = next(r.file for r in written.collect() if r.n_docs)
    opened = tokenfiles.TokenFile(folder, file)
    at = int(np.flatnonzero(opened.nulls == 0)[0])
    assert tokenfiles.read_one(folder, file, int(opened.keys[at])).tolist() == opened.ids(at).tolist()
    (tmp_path / "files" / "dictionary.zdict").write_bytes(b"another")
    with pytest.raises(ValueError):
        tokenfiles.TokenFile(folder, file)
    empty = f"file://{tmp_path}/none"
    assert tokenfiles.read(empty, tokenfiles.write(table(spark, []), empty, WORDS)).count() == 0


def test_word_encoder_is_the_library(spark, sf_dir):
    library = Tokenizer.from_file(WORDS)
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += [t or "" for _, t in ODD] + ["ΑΣ Σ İx ²³¼ ªº µ", "a\x1cb\x85c d", "don't x''s 'sx", "a" * 500, "Été_12"]
    held = tokenfiles.encoder(WORDS)
    assert held.by_word
    for text, ids in zip(texts, held.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


# Records.


def test_warc_derivatives(spark):
    html = '<html lang="fr"><title>A &amp; B</title><body><p>x <b>y</b>z<p>q&lt;<script>"</p>"</script><a href="/u?a=1&amp;b">l</a><br>é</html>'
    pages = spark.createDataFrame(
        [(1, "http://h/p", html, 0), (2, None, None, 0), (3, "http://h/p", "", 0), (3, "http://h/p", "", 0)],
        "page_id long, url string, html string, block int",
    )
    rows = warc.derivatives(warc.responses(pages), "page_id").collect()
    assert [sum(r.page_id == k for r in rows) for k in (1, 2, 3)] == [2, 2, 4]
    source = {r.page_id: r for r in warc.responses(pages).collect()}
    one = {r.warc_type: r for r in rows if r.page_id == 1}
    assert one["conversion"].block.decode() == "x yz\nq<l\né"
    facts = one["metadata"].block.decode()
    assert "title: A & B\r\n" in facts and "language: fr\r\n" in facts and "outlink: http://h/u?a=1&b L a/@href\r\n" in facts
    body = html.encode()
    for r in rows:
        headers = [(h.name, h.value) for h in r.headers]
        assert dict(headers)["WARC-Refers-To"] == r.refers_to == source[r.page_id].record_id
        assert dict(headers)["WARC-Block-Digest"] == warc.digest(bytes(r.block)) == r.block_digest
        assert "WARC-Warcinfo-ID" in dict(headers)
    assert one["metadata"].payload_digest == warc.digest(body)
    file = b"".join(warc.serialise([(h.name, h.value) for h in r.headers], bytes(r.block), True) for r in rows)
    back = list(warc.parse(file))
    assert back == [([(h.name, h.value) for h in r.headers], bytes(r.block)) for r in rows]
    other = warc.derive({"record_id": "r", "target_uri": "u", "date": "", "headers": [], "block": b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89"})
    assert [r["warc_type"] for r in other] == ["metadata"]
    assert [r["warc_type"] for r in warc.derive({"record_id": "r", "target_uri": "", "date": "", "headers": [], "block": b""})] == ["metadata"]
    assert warc.derivatives(warc.responses(pages.limit(0)), "page_id").count() == 0


@pytest.mark.parametrize("page, text, links", [
    ("a <b x='1 > 2'>c</b> d", "a c d", []), ("a < b <3 c", "a < b <3 c", []), ("a<!-- x > y -->b<!-- c", "ab", []),
    ("<a href='/u' title=\"x>y\">t</a>", "t", ["http://h/u"]), ("<a href=u <p>t", "t", ["http://h/u"]),
    ("<a href='u>t", "<a href='u>t", []), ("a<!doctype x>b<?php c", "ab<?php c", []), ("a<script b", "a<script b", []),
    ("a<SCRIPT>b</script >c<style>d", "ac", []), ("<title>a</title>b</title>c", "b\nc", []), ("<a 'q' <a \"", "<a 'q' <a \"", []),
    ("<p 'a\" <p 'b>c", "c", []), ("<p \"'\" x>c<p '>", "c<p '>", []), ("<div><a href=x", "<a href=x", []),
])
def test_pages_with_odd_tags(page, text, links):
    read = warc.read_page(page, "http://h/p")
    assert (read.text, read.links) == (text, links)


def test_tags_end_where_the_stated_pattern_says():
    rng = random.Random(3)
    whole = re.compile(r"<(/?)([a-z][^\s/>\"'<]*+)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>")
    for _ in range(3_000):
        page = "".join(rng.choice(["<p", "<a ", "</p", ">", '"', "'", " x", "=", "<", "/"]) for _ in range(rng.randrange(25)))
        assert [t[:2] for t in warc.tags(page)] == [m.span() for m in whole.finditer(page)], page


@pytest.mark.parametrize("clean", [
    "Una arroba son once kilos, punto.", "Il y a un point de vue, un seul.", "En 2019, un homme. 10 et un.", "好。ok。no。",
    "el punto de la arroba en la hoja",
])
def test_words_of_other_languages_alone_are_no_disguise(clean):
    assert pii.disguised(clean, pii.plain(clean)) == []


def test_malformed_pages_take_time_in_proportion_to_their_length():
    parts = ("<a ", "<a", '<a "', "<a '\" ", "<script ", "<!x ", '<a href="', "<title>", "<!--", "</script ", "<a \"'", "&#", "<a href=")
    for part in parts:
        for end in ("", ">", "'>", '">'):
            warc.read_page(part * 100_000 + end, "http://h/")
    block = b"HTTP/1.1 200 OK\r\nX: y\r\n" + b" z\r\n" * 300_000 + b"\r\nbody"
    assert warc.split_http(block)[1] == [("X", "y" + " z" * 300_000)]


def test_warc_derivatives_keep_every_source_header():
    block = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\nServer: x\r\nX-Empty:\r\nSet-Cookie: a\r\nSet-Cookie: b\r\n\r\n<p>t"
    headers = [
        ("WARC-Type", "response"), ("WARC-Record-ID", "<r>"), ("warc-date", "d"), ("WARC-Target-URI", "u"),
        ("WARC-IP-Address", "1.2.3.4"), ("WARC-Identified-Payload-Type", "text/html"), ("WARC-Truncated", "length"),
        ("X-Crawl", "7"), ("X-Crawl", "8"), ("WARC-Concurrent-To", "<q>"), ("WARC-Payload-Digest", "sha256:p"),
        ("WARC-Block-Digest", "md5:b"), ("Content-Type", "application/http"), ("Content-Length", "99"),
    ]
    rows = warc.derive({
        "record_id": "<r>", "target_uri": "u", "date": "d", "block": block,
        "headers": [{"name": n, "value": v} for n, v in headers],
    })
    assert [r["warc_type"] for r in rows] == ["metadata", "conversion"]
    same = ("WARC-IP-Address", "X-Crawl", "WARC-Concurrent-To")
    want = [(n if n in same else f"Source-{n}", v) for n, v in headers if n not in ("WARC-Record-ID", "warc-date", "WARC-Target-URI")]
    for r in rows:
        found = [(h["name"], h["value"]) for h in r["headers"]]
        assert [x for x in found if x in want] == want
        own = dict(x for x in found if x not in want)
        assert own["WARC-Payload-Digest"] == r["payload_digest"] == warc.digest(b"<p>t")
        assert own["WARC-Block-Digest"] == warc.digest(r["block"]) and own["WARC-Refers-To"] == "<r>"
        names = [n.lower() for n, _ in found if n != "X-Crawl"]
        assert len(names) == len(set(names))
    facts = rows[0]["block"].decode().split("\r\n")
    assert [x for x in facts if x.startswith("http-header")] == [
        f"http-header: {x}" for x in ("Content-Type: text/html", "Server: x", "X-Empty: ", "Set-Cookie: a", "Set-Cookie: b")
    ]


# Shards.


def test_shards(spark, monkeypatch):
    rows = [(i, "x" * (i % 7)) for i in range(4000)] + [(None, None), (5, "again"), (5, "again")]
    monkeypatch.setattr(sharding, "ROWS_PER_PIECE", 300)
    found = sharding.assign(table(spark, rows)).collect()
    assert len(found) == len(rows)
    for shard, group in itertools.groupby(sorted(found, key=lambda r: (r.shard, r.slot)), key=lambda r: r.shard):
        slots = [r.slot for r in group]
        assert slots == list(range(len(slots))) and abs(len(slots) - 500) < 120, shard
    assert all(r.grown_shard in (r.shard, 8) for r in found)
    assert 300 < sum(r.grown_shard == 8 for r in found) < 600
    texts = {i: t for i, t in rows if i != 5}
    assert all(
        r.size == len(texts[r.doc_id] or "") + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
        for r in found if r.doc_id in texts
    )
    monkeypatch.setattr(sharding, "ROWS_PER_PIECE", 10**6)
    again = sharding.assign(table(spark, rows)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert sharding.assign(table(spark, [])).count() == 0


def test_movement_stays_in_the_subtree_whose_weight_changes(spark):
    tree = sharding.balanced_tree()
    changed = [leaf._replace(weight=3.0) if leaf.shard == 1 else leaf for leaf in tree]
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    rows = keys.select(
        sharding.shard_of(F.col("k"), tree).alias("old"), sharding.shard_of(F.col("k"), changed).alias("new")
    ).groupBy("old", "new").count().collect()
    moved = {(r.old, r.new): r["count"] for r in rows}
    share = sum(n for (_, new), n in moved.items() if new == 1) / 20_000
    assert math.isclose(share, 0.3, abs_tol=0.02)
    same_rack = {0: 0, 1: 0, 2: 1, 3: 1}
    for (old, new), _ in moved.items():
        if old >= 4:  # the other region: rows leave it for the changed one or stay
            assert new == old or new < 4
        elif same_rack.get(old) == 1:
            assert new == old or new in (0, 1)


# The pipeline.


@pytest.mark.parametrize("labelled", [None, 0, 1])
def test_language_stage_without_labels_to_learn_from(spark, labelled):
    keys = spark.range(50).withColumn("aside", language.held_out(F.col("id"))).collect()
    aside = next(r.id for r in keys if r.aside)
    taught = next(r.id for r in keys if not r.aside)
    label = {None: {}, 0: {aside: "en"}, 1: {taught: "en"}}[labelled]
    rows = [(aside, "a clean text", label.get(aside)), (taught, "another text", label.get(taught)), (60, "12 3", None), (61, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept == ({aside: "en", taught: "en"} if labelled else {aside: label.get(aside), taught: None})


def test_last_stage_decodes(spark):
    texts = {1: "a text", 2: "with ▁ in it", 3: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = corpus_pipeline.tokens(spark, docs, "")
    assert found.columns == ["doc_id", "text", "ids", "n_ids", "round_trip"]
    assert {r.doc_id: r.round_trip for r in found.collect()} == {1: True, 2: False, 3: True}


def test_pipeline(spark, tmp_path):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("aeioutrns") for _ in range(rng.randrange(1, 8))) for _ in range(n))
    item, shared = prose(30), "\n".join(prose(20) for _ in range(3))
    base = prose(120)
    texts = {
        1: base, 2: base + " end", 3: item + " " + prose(40), 4: prose(50) + "\n" + shared,
        5: prose(70) + "\n" + shared + "\n" + prose(5), 6: "123 456", 7: None, 8: prose(60),
    }
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [1, 4, 5, 8]
    assert rows[4].text == texts[4] and rows[5].text == texts[5].replace("\n" + shared, "")
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert all(r.ids == library.encode(r.text) and r.n_ids == len(r.ids) for r in rows.values())
    assert [name for name, _ in corpus_pipeline.STAGES][2] == "n-gram jaccard join"
    assert hashlib.sha256(rows[1].text.encode()).digest() == hashlib.sha256(base.encode()).digest()


def test_a_memo_keeps_to_its_bound_and_lets_long_words_pass():
    held = memo.Memo(lambda words: [w.encode() for w in words], 20_000)
    rng = random.Random(1)
    for _ in range(300):
        words = {f"w{rng.randrange(3000)}" for _ in range(20)} | {"x" * rng.choice([9, 5000])}
        known = held.of(words)
        assert all(known[w] == w.encode() for w in words)
        assert sum(200 + 2 * len(w) for w in held.known if len(w) < memo.LONG) <= 20_000 + 5_000
        assert sum(len(w) > memo.LONG for w in held.known) <= 1 and not any(len(w) > memo.LONG for w in held.old)


def test_language_vectors_do_not_depend_on_the_cuts(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcéß語") for _ in range(5)) for _ in range(n)) for n in (0, 3, 400)] + ["語" * 900]
    whole = language.bundle(texts)
    grouped = language.bundle(texts, np.array([0, 1, 1, 0]), 2)
    monkeypatch.setattr(language, "GRAMS", 7)
    monkeypatch.setattr(language, "SEGMENT", 50)
    assert np.array_equal(language.bundle(texts), whole)
    assert np.array_equal(language.bundle(texts, np.array([0, 1, 1, 0]), 2), grouped)
    assert np.array_equal(grouped[0], whole[0] + whole[3])


def test_language_of_a_long_text_without_spaces_takes_bounded_memory():
    rng = random.Random(3)
    text = "".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(200_000))
    tracemalloc.start()
    language.bundle([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20, peak


def test_a_word_longer_than_a_segment_has_the_same_hash(monkeypatch):
    texts = [b"aa " + b"abcdefg" * 4000 + b" bb cc", b"x" * 9000]
    whole = shingles.word_hashes(texts)[0].tolist()
    monkeypatch.setattr(shingles, "SEGMENT", 1000)
    assert shingles.word_hashes(texts)[0].tolist() == whole


def test_token_files_are_read_by_as_many_tasks(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} of some") for i in range(200)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    written = tokenfiles.write(docs, f"file:{tmp_path}/ids", WORDS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    found = tokenfiles.read(f"file:{tmp_path}/ids", written)
    assert written.count() > 2 and found.rdd.getNumPartitions() == written.count()
    assert found.count() == 200


def test_pipeline_keeps_the_row_with_the_least_text_of_those_with_one_id(spark, sf_dir):
    rows = [(1, "b a c d e f", "en", 7), (1, "a b c d e f", "fr", 8), (1, "a b c d e f", "en", 9), (2, None, "x", 1), (None, "z", "x", 1), (None, "z", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, row int")
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[2], *rows[3:]], key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), sf_dir).count() == 0


def test_an_id_table_keeps_to_its_bound_and_looks_up_a_word_once(monkeypatch):
    monkeypatch.setattr(memo, "SEGMENT", 7)
    asked = []
    held = memo.IdTable(lambda words: asked.append(words) or [np.array([*w.encode()], "<u4").tobytes() for w in words], 20_000)
    rng = random.Random(4)
    for step in range(300):
        texts = [" ".join(f"w{rng.randrange(1500)}" for _ in range(rng.randrange(9))) for _ in range(6)]
        texts += ["", " a é\n\ta ", "　", "y" * rng.choice([1, 30_000])]
        want = [np.array([*"".join(t.split()).encode()], "<u4").tobytes() for t in texts]
        assert held.join_all(texts) == want and held.join_all(texts[::-1]) == want[::-1]
        kept = sum(24 + len(w.encode()) * 5 for w in held.words.to_pylist())
        assert kept <= 20_000 + 5 * 30_000 + 5_000
    assert all(len(set(words)) == len(words) for words in asked) and held.join_all([]) == []
    # The second call of a step finds all its words, so no more than one call in two encodes.
    assert len(asked) <= 2 * 300 and "a" in asked[0] and sum("a" in words for words in asked) < 150
    held.join_all(["b"])
    held.join_all(["c"])
    assert sum(24 + len(w.encode()) * 5 for w in held.words.to_pylist()) <= 20_100
