"""Private items, look-alike texts, tokens and languages against small fixtures with known answers."""

import random
import re
import unicodedata

import pytest

from lodeline.llm import language, lookalike, private, tokens

KEY = b"k" * 32


def kinds(text):
    form, at = lookalike.fold_with_offsets(text)
    return [(form[a:b], k, a if at is None else at[a]) for a, b, k in private.items(form)]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("写信到abc_1@mail.example.org谢谢", [("abc_1@mail.example.org", "email", 3)]),
        ("bri [at] mail [dot] example", [("bri [at] mail [dot] example", "email", 0)]),
        ("加我+８６ １３９００００２２５８ ok", [("+86 13900002258", "phone", 2)]),
        ("ring (888) 555-0144, thanks", [("(888) 555-0144", "phone", 5)]),
        ("订单号16000003779", []),
        ("order no. 2245556999", []),
        ("id 913-37-1703.", [("913-37-1703", "id_number", 3)]),
        ("code 04962637E", []),
        ("12345678Z", [("12345678Z", "id_number", 0)]),
        ("地址：云荷县杉翎巷80号2单元444 谢谢", [("云荷县杉翎巷80号2单元444", "address", 3)]),
        ("ship to Flat 4, 189 Holdodan Road; ok", [("Flat 4, 189 Holdodan Road", "address", 8)]),
        ("a poem on my street", []),
        ("我叫祝渺 谢谢", [("祝渺", "name", 2)]),
        ("my name is Istdobeck D. Umbsta, hi", [("Istdobeck D. Umbsta", "name", 11)]),
        ("i am tired of the reader", []),
        ("5 books @ 12 each, @abcdef", []),
        ("我​叫祝​渺", [("祝渺", "name", 3)]),
        ("", []),
    ],
)
def test_items(text, found):
    assert kinds(text) == found


def test_citizen_number_needs_its_check_character():
    seventeen = "99794119901001061"
    right = next(c for c in "0123456789X" if private.citizen_ok(seventeen + c))
    for c in "0123456789X":
        assert bool(kinds("编号" + seventeen + c)) == (c == right)


def test_pseudonyms_link_and_keep_the_format():
    a, b = private.pseudonym("+86 139 0000 2258", "phone", KEY), private.pseudonym("13900002258", "phone", KEY)
    assert a.startswith("+86 1") and a[4:].replace(" ", "") == b != "13900002258" and re.fullmatch(r"1[3-9]\d{9}", b)
    a, b = private.pseudonym("(415) 555-1234", "phone", KEY), private.pseudonym("+1 415 555 1234", "phone", KEY)
    assert re.fullmatch(r"\([2-9]\d\d\) [2-9]\d\d-\d{4}", a) and b.startswith("+1 ") and re.sub(r"\D", "", b) == "1" + re.sub(r"\D", "", a) != "14155551234"
    assert re.sub(r"\D", "", private.pseudonym("+44 7700 900352", "phone", KEY))[2:] == private.pseudonym("07700900352", "phone", KEY)[1:]
    assert re.fullmatch(r"0[1-9]\d{2}-\d{8}", private.pseudonym("0798-55502126", "phone", KEY))
    assert len({private.pseudonym(x, "email", KEY) for x in ("ann@school.org", "Ann [at] school.org", "ann at school dot org", "ann（at）school[dot]org")}) == 1
    seventeen = "99794119901001061"
    number = seventeen + next(c for c in "0123456789X" if private.citizen_ok(seventeen + c))
    p = private.pseudonym(number, "id_number", KEY)
    assert private.citizen_ok(p) and p != number
    assert private.letter_ok(*(lambda x: (x[:8], x[8]))(private.pseudonym("12345678Z", "id_number", KEY)))
    assert private.pseudonym("A@b.example", "email", KEY) == private.pseudonym("a@B.example", "email", KEY)


@pytest.mark.parametrize("size", [1, 2, 10, 97, 1000])
def test_feistel_is_a_permutation(size):
    assert sorted(private.feistel(i, size, KEY) for i in range(size)) == list(range(size))


def test_redact_and_find_in_spark(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "x" * 100_000 + " a@b.example", 7), (4, "联系a@b.example 好", 7), (4, "联系a@b.example 好", 7), (None, "nothing", 7)]
    df = spark.createDataFrame(rows, "row_id long, query string, kind int")
    found = private.find_private(df, "row_id", "query").select("row_id", "kind", "start_pos").collect()
    assert sorted((r.row_id, r.kind, r.start_pos) for r in found) == [(3, "email", 100_001), (4, "email", 2), (4, "email", 2)]
    out = {(r.row_id, r.out) for r in private.redact(df, "query", "out", "secret").collect()}
    assert (1, None) in out and (2, "") in out and (None, "nothing") in out
    assert all("@" not in (o or "") for _, o in out) and any(o and o.startswith("联系[email:") and o.endswith("] 好") for _, o in out)
    assert private.find_private(df.limit(0), "row_id", "query").count() == 0
    with pytest.raises(ValueError):
        private.redact(df, "query", "out", "")


def test_equal_values_are_linked_over_documents(spark):
    rows = [(1, "mail ann@school.org now"), (2, "mail ann [at] school.org, tel (415) 555-1234"), (3, "call +1 415 555 1234 or 13900002258"), (4, "call +86 139 0000 2258"), (5, "mail bob@school.org")]
    df = spark.createDataFrame(rows, "row_id long, query string")
    got = {r.kind: tuple(r)[1:] for r in private.links(df, "row_id", "query", "secret").collect()}
    assert got == {"email": (3, 2, 2, 1, True, True), "phone": (4, 2, 2, 2, True, True)}


def test_numbers_with_a_label_are_no_phone_numbers():
    assert kinds("order number:" + " " * 40 + "13900002258") == [] and kinds("订单号：# 13900002258") == []
    assert [k for _, k, _ in kinds("reorder please 13900002258")] == ["phone"]


def test_fold_reads_same():
    same = [("ｔake а​ ﬁeld", "take a field"), ("a b", "a b"), ("⼩助手", "小助手"), ("café", "café"), ("ａ́", "á"), ("，", ",")]
    for a, b in same:
        assert lookalike.fold(a) == lookalike.fold(b)
    for a, b in [("A", "a"), ("e", "é"), ("1", "¹"), ("3", "③"), ("国", "國"), ("a", "a!"), ("ab", "a b")]:
        assert lookalike.fold(a) != lookalike.fold(b)
    for a, b in [("α粒子", "a粒子"), ("ρ=m/V", "p=m/V"), ("νοῦς", "voῦς"), ("👨\u200d👩\u200d👧", "👨👩👧"), ("𝐚𝐛", "ab")]:
        assert lookalike.fold(a) != lookalike.fold(b)
    for a, b in [("νersion ν2", "version v2"), ("hοmepage", "homepage"), ("cαt", "cat"), ("ꓐꓮ", "BA"), ("a\u200db", "ab"), ("☀️\u200d🌧", "☀\u200d🌧")]:
        assert lookalike.fold(a) == lookalike.fold(b) and lookalike.fold(lookalike.fold(a)) == lookalike.fold(a)
    assert lookalike.fold(None) is None and lookalike.fold("") == ""


def test_fold_is_idempotent_and_offsets_point_back():
    rng = random.Random(1)
    pool = "aé́ｂа​ ﬁ　⼩中1¹"
    for _ in range(300):
        t = "".join(rng.choice(pool) for _ in range(rng.randrange(12)))
        f = lookalike.fold(t)
        assert lookalike.fold(f) == f
        g, at = lookalike.fold_with_offsets(t)
        assert g == f and (at is None or (len(at) == len(g) and at == sorted(at)))
        assert unicodedata.normalize("NFC", f) == f


def test_find_disguised(spark):
    rows = [(1, "а", "a"), (2, "a", "a"), (3, None, "a"), (4, "é", "e"), (5, "x​y", "xy"), (5, "x​y", "xy"), (6, "", "​")]
    df = spark.createDataFrame(rows, "row_id long, query string, nn_query string")
    assert sorted(r.row_id for r in lookalike.find_disguised(df, "query", "nn_query").collect()) == [1, 5, 5, 6]
    assert lookalike.find_disguised(df.limit(0), "query", "nn_query").count() == 0


TEXTS = [None, "", "   ", "\n", "Hello world's <|endoftext|> end", "你好，世界 12345", "🙂🙂 7\r\n\tx  y", "ab" * 20_000, "Hello world's <|endoftext|> end"]


@pytest.mark.parametrize("common", [0, 3, tokens.COMMON])
def test_tokens_round_trip(spark, monkeypatch, common):
    """Whatever part of the words is put in without a shuffle."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "COMMON", common)

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in tokens.encode(df, "doc_id", "text").collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    back = tokens.decode(tokens.encode(df, "doc_id", "text"), "doc_id", "ids")
    assert {r.doc_id: r.text for r in back.collect()} == {i: x or "" for i, x in enumerate(TEXTS)}
    counts = {r.doc_id: r.n for r in tokens.count(df, "text", "n").collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


EN, DE, ZH = "The weights were scaled again once the filter had been applied.", "Die Gewichte wurden erst nach dem Filtern neu berechnet.", "过滤完成以后才重新归一化权重。"


def test_languages(spark):
    train = [(i, t, l) for i, (t, l) in enumerate([(EN, "en-US"), (DE, "deu"), (ZH, "zho")] * 8)]
    cases = [(100, EN, None), (101, DE, "en"), (102, EN + "\n" + DE + "\n---", "en"), (103, None, "en"), (104, "12;3", None), (105, ZH + "“the weights”", "zh"), (106, "", None)]
    df = spark.createDataFrame(train + cases, "doc_id long, text string, lang string")
    found = language.find_wrong(language.judge_rows(df, "doc_id", "text", "lang"))
    assert sorted((r.doc_id, r.segment, r.lang) for r in found.collect()) == [(100, 0, "en"), (101, 0, "de"), (102, 1, "en"), (102, 2, "de")]
    assert language.judge_rows(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_forward_sums_all_segmentations():
    import numpy as np

    p = {"▁": 0.2, "a": 0.3, "b": 0.1, "ab": 0.15, "▁a": 0.25}
    known = {k: i for i, k in enumerate(p)}
    m = language.Model(language._with_beginnings(known), len(p), np.array([[v] * 7 for v in [*p.values(), 1e-9, 1e-9, 1e-9, 1e-9]]))
    want = p["▁"] * p["a"] * p["b"] + p["▁"] * p["ab"] + p["▁a"] * p["b"]
    got = m.words({"ab", "a", "b" * 40})
    assert np.allclose(np.exp(got["ab"]), want) and np.allclose(np.exp(got["a"]), p["▁"] * p["a"] + p["▁a"])
    assert np.allclose(got["b" * 40], np.log(0.2) + 40 * np.log(0.1))
    # forward and backward agree at every place, for words of different lengths
    x = language.Lattice(["ab", "a", "abab"], m.known, m.n_pieces)
    q = m.table[x.piece]
    f, g = x.forward(q), x.backward(q)
    assert np.allclose(x.ends(f), g[0]) and np.isfinite(np.log(x.ends(f))).all()


def test_short_lines_are_judged(spark):
    """No length decides: a line of one word has a row in a mixed document, and does not make one alone unless it is sure."""
    train = [(i, t, l) for i, (t, l) in enumerate([(EN, "en"), (DE, "de"), (ZH, "zh")] * 8)]
    df = spark.createDataFrame([*train, (100, EN + "\n" + DE + "\nfilter", None)], "doc_id long, text string, lang string")
    rows = {r.segment: r for r in language.judge_rows(df, "doc_id", "text", "lang").where("doc_id = 100").collect()}
    assert set(rows) == {0, 1, 2, 3} and all(0 < r.confidence <= 1 for r in rows.values())
