"""Personal data, secrets and packing."""

import random
import re
import zlib
from math import log10

import numpy as np
import pytest
from tokenizers import Tokenizer

from shelfmark.llm import packing, pii_crf, secrets_guess
from shelfmark.llm.common import prepare
from shelfmark.llm.queries import _digest
from shelfmark.llm.spans import ordered, replaced
from tests.llm import brute


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    prepare(spark)


@pytest.fixture(scope="module")
def field():
    return pii_crf.train()


def plain_pii(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
                          ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
                          ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and max(map(int, m[0].split("."))) > 255
                    or kind == "card" and not (14 <= len(digits) <= 19 and pii_crf.luhn(digits))
                    or kind == "phone" and not 10 <= len(digits) <= 15):
                continue
            out.append((*m.span(), kind))
    return ordered(out, pii_crf.KINDS)


def plain_secrets(text):
    out = []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(*m.span(), "assign") for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 12]
    out += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ordered(out, secrets_guess.KINDS)


def test_base_patterns_equal_plain_search():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("a1 @.-+2%()0é") for _ in range(rng.randrange(30)))
        assert pii_crf.base_spans(text) == plain_pii(text), text
        parts = rng.choices(["token", "Secret", "api_key", " ", "=", ":", '"', "1f", "AKIA", "AKIAABCDEF", "0123abcd",
                             "ff", "x", "Z9", "pa\u017f\u017fword", "password"], k=rng.randrange(14))
        assert secrets_guess.base_spans("".join(parts)) == plain_secrets("".join(parts)), parts


def test_field_finds_what_the_patterns_miss(field):
    text = "call (415) 555-0132 or +1 (269) 555-3296 4524132264652876 in 2019, chapter 12"
    base, spans = pii_crf._all_spans(field, [text])[0]
    assert base == [] and text[spans[0][0]:spans[0][1]] == "(415) 555-0132" and spans[0][2] == "phone"
    clean = "in 2019 there were 300 people, see page 12 and section 3.2 or version 2.14.1"
    assert pii_crf._all_spans(field, [clean])[0] == ([], [])
    wrong = 0
    for words, labels in pii_crf._examples(pii_crf.SENTENCES):
        found = pii_crf.field_spans(field, [" ".join(words)])[0]
        wrong += bool(found) != any(labels)
    assert wrong == 0


def test_field_joins_over_any_white_space(field):
    for gap in (" ", "\u00a0", "\u2009", "\n", " \n "):
        text = f"bitte{gap}telefon{gap}0221{gap}555{gap}0187 oder schreiben"
        assert [(text[s:e], k) for s, e, k in pii_crf.field_spans(field, [text])[0]] == [
            (f"0221{gap}555{gap}0187", "phone")], repr(gap)
        text = f"card 4111{gap}1111{gap}1111{gap}1111 expires soon"
        assert [(text[s:e], k) for s, e, k in pii_crf.field_spans(field, [text])[0]] == [
            (text[5:-13], "card")], repr(gap)
    far = "telefon" + " " * 60 + "0221 555 0187" + " " * 60 + "oder"
    assert pii_crf._runs(far)[0][0] == ["telefon", "0221", "555", "0187", "oder"]
    assert pii_crf.shape("x" * 80 + "@mail.example.com") == "a@a.a.a"


TEXTS = [None, "", "plain words", "x@y.example.com x@y.example.com", "é 1.2.3.4 \U0001F600 +1 (988) 555-2485", "0" * 9000,
         "4111 1111 1111 1111 and 999.1.1.1", "a@" * 3000 + "b.c", "1.2.3." * 2000, "+1" + "(" * 5000,
         "password=b7db7aa4a5fcc78305 pwd: x7$Kp9!vQ2z pass: summer2019", "\u0130 token = 'abcdefghijklmnop'"]


def test_find_spans(spark, field):
    docs = brute.frame(spark, TEXTS, [1, 2, 2, None, *range(5, 5 + len(TEXTS) - 4)])
    rows = _digest(pii_crf.find(docs, field), pii_crf.KINDS).collect()
    assert sorted(r.base_sha256 for r in rows) == sorted(brute.digest(plain_pii(t or "")) for t in TEXTS)
    rows = _digest(secrets_guess.find(docs, top=100), secrets_guess.KINDS[:3]).collect()
    assert sorted(r.base_sha256 for r in rows) == sorted(brute.digest(plain_secrets(t or "")) for t in TEXTS)
    assert sum("guess" in r.spans for r in rows) == 1  # the hard one of the two short passwords
    assert pii_crf.find(docs.limit(0), field).count() == 0 and secrets_guess.find(docs.limit(0)).count() == 0


def test_redact(spark, field):
    docs = brute.frame(spark, TEXTS)
    rows = {r.doc_id: r for r in pii_crf.redact(docs, field).collect()}
    assert pii_crf.redact(docs, field).schema == docs.schema
    assert rows[3].text == "[EMAIL] [EMAIL]" and rows[3].n_chars == 15 and rows[0].text is None
    assert rows[4].text == "é [IP] \U0001F600 [PHONE]" and rows[2].text == "plain words"
    assert replaced("abcdef", [(1, 4, "x"), (2, 5, "y")]) == "a[X]f"


def test_guess_cost():
    ranks = {"password": 1, "summer": 30, "correct": 900, "horse": 500}
    cost = lambda v: secrets_guess.guess_cost(v, ranks)
    assert cost("password123") < 4 and cost("qwertyuiop") < 4 and cost("aaaaaaaaaa") < 3 and cost("Summer2019") < 6
    assert cost("correcthorse") < 7 < cost("x7$Kp9!vQ2") and cost("12/05/1999") < 6
    assert cost("") == 0 and cost("x" * 10_000) < 6


def plain_cost(value, ranks):
    """The cheapest segmentation, all ways tried."""
    low, n = value.lower(), len(value)
    walks, best = secrets_guess._walks(low), [0.0] + [float("inf")] * len(value)
    for i in range(n):
        ways = [(j, float(j - i)) for j in range(i + 1, n + 1)]
        for j in range(i + 3, min(n, i + 24) + 1):
            if low[i:j] in ranks:
                upper, tail = value[i:j] != low[i:j], value[i + 1:j] != low[i + 1:j]
                ways.append((j, log10(ranks[low[i:j]] + 1) + (log10(j - i + 1) if tail else log10(2) if upper else 0)))
        for m in (secrets_guess._DATE.match(value, i, end) for end in range(i + 4, min(n, i + 10) + 1)):
            ways += [(m.end(), log10(119) if m.end() - i == 4 else log10(119 * 365))] if m else []
        ways += [(i + k, log10(40 * k)) for k in range(3, walks[i] + 1)]
        for w in range(1, (n - i) // 2 + 1):
            times = 1
            while low.startswith(low[i:i + w], i + times * w):
                times += 1
            if times > 1 and times * w >= 3:
                chunk = min(w, log10(ranks[low[i:i + w]] + 1) if low[i:i + w] in ranks else 99)
                ways.append((i + times * w, chunk + log10(times)))
        for j, cost in ways:
            best[j] = min(best[j], best[i] + cost + (log10(2) if i else 0))
    return best[n]


def test_whole_values_are_priced():
    rng = random.Random(6)
    ranks = {"password": 1, "summer": 30, "correct": 900, "horse": 500, "abab": 70, "word": 9}
    chunks = ["password", "Summer", "coRRect", "horse", "abab", "ab", "a", "7", "qwerty", "1234", "4321", "2019", "xK", "!",
              "0123456789012345678901234567890", "aaaaaaa", "12/05/1999", "ababababababababab", "efefedefgfe"]
    under = 0
    for _ in range(3000):
        value = "".join(rng.choices(chunks, k=rng.randrange(1, 7))) * rng.choice((1, 1, 1, 3))
        exact, found = plain_cost(value, ranks), secrets_guess.guess_cost(value, ranks)
        assert abs(exact - found) < 1e-9 if exact < secrets_guess.MIN_COST else found >= secrets_guess.MIN_COST, value
        under += exact < secrets_guess.MIN_COST
    assert 300 < under < 2900
    assert secrets_guess.guess_cost("x" * 200 + "Zq9!xV7kTr2m", ranks) >= secrets_guess.MIN_COST
    for long in ("ab" * 50_000, "x" * 100_000, "Zq9!xV7kTr2m" * 10_000, "0123456789" * 10_000):  # in linear time
        assert secrets_guess.guess_cost(long, ranks) > 3


def test_contexts_are_found_whole(spark):
    texts = ["pwd:     Zq9!xV7kTr2m", "credentials: password: Zq9!xV7kTr2m", "auth: token: Zq9!xV7kTr2m", "pwd: " + "x" * 200 +
             "Zq9!xV7kTr2m", "auth:token=Zq9!xV7kTr2m", "pwd: !Zq9(xV7k~0123456789abcdef~Tr2m"]
    rows = secrets_guess.find(brute.frame(spark, texts)).orderBy("doc_id").collect()
    found = [[(t[s.start:s.end], s.kind) for s in r.spans] for t, r in zip(texts, rows)]
    assert found == [[("Zq9!xV7kTr2m", "guess")]] * 3 + [[("x" * 200 + "Zq9!xV7kTr2m", "guess")], [(
        "token=Zq9!xV7kTr2m", "guess")], [("!Zq9(xV7k~", "guess"), ("0123456789abcdef", "hex"), ("~Tr2m", "guess")]]


def test_words_of_any_rank_price_a_value(spark):
    rng = random.Random(4)
    words = {"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(21_000)} - {"zzzyqxkwv"}
    docs = brute.frame(spark, [" ".join([*words, *words, "zzzyqxkwv"]), "pwd: zzzyqxkwv", "pwd: zq9zy!xk7wv"])
    spans = {r.doc_id: r.spans for r in secrets_guess.find(docs).collect()}
    assert spans[1] == [] and [tuple(s) for s in spans[2]] == [(5, 16, "guess")]
    ranks = {r.word: r.rank for r in secrets_guess.word_ranks(docs.repartition(5)).collect()}
    first = len(secrets_guess.COMMON_RANKS) + 1
    assert sorted(ranks.values()) == list(range(first, first + len(ranks))) and len(ranks) > 20_000
    # "zzzyqxkwv" and the 21,000 come twice, "pwd" too: all alike, so the order is the words'.
    assert sorted(ranks, key=ranks.get) == sorted({*words, "zzzyqxkwv", "pwd"})


def test_tokens_equal_the_tokenizer():
    own, plain = packing.Encoder(packing.VOCABULARY), Tokenizer.from_file(packing.VOCABULARY)
    rng = random.Random(2)
    alphabet = "abcE'sRtT é É ß \u00a0\u0085\x1c½²ªº.,!?-09Σς \u0130\u4e2d\U0001F600\n\t\u0301"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(3000)]
    texts += ["", "<|endoftext|> x", "it's WE'LL 'd", "x" * 500, brute.prose(500)]
    for text in texts:
        ids = plain.encode(text, add_special_tokens=False).ids
        assert own(text.encode()) == np.array(ids, dtype="<u4").tobytes(), text


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 101): rng.randrange(1, 400) for _ in range(40)}
    for groups in (3, 8):
        rows, opened = packing.plan(counts, 100, groups=groups)
        used = [0] * opened
        placed = {}
        for k, (length, rank, bins, first, offset) in enumerate(rows.tolist()):
            end = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == length else counts[length]
            assert rank == placed.get(length, 0)
            for r in range(rank, end):
                behind, b = divmod(r - rank, bins)
                assert offset + behind * length >= 0
                used[first + b] += length
            placed[length] = end
        assert placed == counts and max(used) <= 100 and min(used) > 0
    best = packing.best_plan(counts, 100)[1]
    assert best <= 1.01 * brute.best_fit_decreasing(counts, 100) + 1


def test_pack(spark):
    texts = [None, "", "same text here", "same text here", brute.prose(9000, 3), "é ß", *[brute.prose(k) for k in range(60)]]
    docs = brute.frame(spark, texts, [1, 1, 2, 2, None, *range(5, 5 + len(texts) - 5)])
    rows = packing.pack(docs, capacity=512, salt_rows=3).collect()
    plain = Tokenizer.from_file(packing.VOCABULARY)
    expected = []
    for row, text in zip(docs.collect(), texts):
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        expected += [(row.doc_id, s // 512, s, len(ids[s:s + 512]), zlib.crc32(ids[s:s + 512].tobytes()))
                     for s in range(0, len(ids), 512)]
    assert sorted(str(tuple(r)[:5]) for r in rows) == sorted(map(str, expected))
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 512
    assert packing.pack(docs.limit(0)).count() == 0
