import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rondo.llm import collocations as C
from rondo.llm import divergence as D
from rondo.llm import personal_data as P

SCHEMA = "doc_id long, text string, lang string, source string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def texts(seed, n, words, size=40):
    r = np.random.default_rng(seed)
    marks = ["", "", "", "", ",", ".", "\n", "\t", "; "]
    pick = lambda k: " ".join(words[int(i)] + marks[int(r.integers(len(marks)))] for i in np.minimum(r.geometric(0.12, k), len(words)) - 1)
    return [pick(int(r.integers(0, size))) for _ in range(n)]


# --- sources


def audit_by_hand(rows, least, ranks):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        key = (lang or "", source or "")
        groups.add(key)
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text))
        count[key].update(terms)
        docs[key[0]].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        own = sorted(g for g in groups if g[0] == lang)
        total = {g: sum(count[g][t] for t in kept) for g in own}
        p = {g: {t: 1 + 10**9 * (count[g][t] + 5) // (total[g] + 5 * len(kept)) for t in kept} for g in own}
        whole = {t: sum(count[g][t] for g in own) for t in kept}
        q = {t: 1 + 10**9 * (whole[t] + 5) // (sum(total.values()) + 5 * len(kept)) for t in kept}
        for g in own:
            pairs = sorted(((-sum(abs(p[g][t] - p[h][t]) for t in kept), h[1].encode()) for h in own if h != g))
            out |= {(*g, "pair", s.decode(), -v, k) for k, (v, s) in enumerate(pairs, 1)}
            best = sorted((q[t] - p[g][t], t.encode()) for t in kept if count[g][t] and p[g][t] > q[t])[:ranks]
            out |= {(*g, "term", t.decode(), -v, k) for k, (v, t) in enumerate(best, 1)}
    return out


WORDS = ["the", "Of", "and", "é", "été", "naïve", "a1b", "x", "long", "İstanbul", "日本", "z"] + [f"w{chr(97 + k)}" for k in range(20)]


@pytest.mark.parametrize("sides", [64, 2])
def test_audit_equals_brute_force(spark, sides):
    rows = [(k, t, [None, "en", "fr"][k % 3], [None, "a", "b", "é", "hot", "hot"][k * 7 % 6]) for k, t in enumerate(texts(1, 120, WORDS))]
    rows += [(0, None, "en", "empty"), (None, "", "xx", "alone"), (7, rows[7][1], "en", "a"), (7, rows[7][1], "en", "a"), (1, "...", "yy", "p"), (2, None, "yy", "q")]
    got = D.audit(spark.createDataFrame(rows, SCHEMA), 4, 6, sides, 8).collect()
    assert {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got} == audit_by_hand(rows, 4, 6) and len(got) == len(set(got))


def test_audit_of_nothing_and_long_texts(spark):
    assert D.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    text = ("aB é, " * 900_000)[: 5 << 20].encode("utf-8", "ignore")
    parts = list(D._segments(text, 1 << 20))
    assert len(parts) > 4 and Counter(w for p in parts for w in D._TERM.findall(p)) == Counter(D._TERM.findall(text.lower()))
    rows = [(k, "x " * 400_000, "en", "ab"[k % 2]) for k in range(2)]
    got = D.audit(spark.createDataFrame(rows, SCHEMA), 2).collect()
    assert {(r.source, r.part, r.item, r.value) for r in got} == {("a", "pair", "b", 0), ("b", "pair", "a", 0)}


@given(st.integers(0, 10**13), st.integers(0, 10**15))
def test_share_is_exact(count, more):
    total = count + 5 + more
    assert D.share(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 5) // total


# --- phrases


def mined_by_hand(rows, least, ranks):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        n[lang] += 0
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        found = []
        some = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = {s for p, a in some.items() for k in range(2, len(p)) for s in (p[i : i + k] for i in range(len(p) - k + 1)) if 100 * a >= 80 * own[s]}
        for p, a in some.items():
            ways = [(2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(ways)
            if p not in inside:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, x, y, n[lang], -s) for k, (s, a, p, x, y) in enumerate(sorted(found)[:ranks], 1)]
    return set(out)


@pytest.mark.parametrize(("limit", "chunk", "segment"), [(500_000, 4 << 20, 1 << 20), (20, 300, 1 << 20), (60, 200, 40)])
def test_phrases_equal_brute_force(spark, limit, chunk, segment):
    rows = [(k, t, [None, "en", "fr"][k % 3]) for k, t in enumerate(texts(2, 150, ["Of", "the", "é", "\x01", "a_b"] + [f"w{k}" for k in range(15)]))]
    rows += [(k, "one Two three four five. one two, one two three four five six", "en") for k in range(9)] * 2 + [(0, None, "xx"), (1, "", None), (None, " \t\n .,", "en")]
    got = C.mine(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 5, 40, limit, chunk, segment).collect()
    want = mined_by_hand(rows, 5, 40)
    assert {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got} == want and len(got) == len(want) > 60
    assert any(len(r.phrase.split()) == 4 for r in got)


def test_phrases_of_nothing(spark):
    assert C.mine(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    assert C.mine(spark.createDataFrame([(1, "a b c", "en")], "doc_id long, text string, lang string")).count() == 0


def test_score_of_large_counts(spark):
    rows = [(1, 0, 0, 0, 10**14), (2, 0, 0, 0, 3 * 10**14), (1, 2, 0, 0, 99_999_999_999_999)]
    got = C.scored(spark.createDataFrame(rows, "w1 long, w2 long, w3 long, w4 long, f long")).collect()
    assert [r.score for r in got] == [2_000_000 * 99_999_999_999_999 // (4 * 10**14)]


# --- personal data

NAIVE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+".replace(r"[\x20-]", "[ -]"),
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_by_hand(text):
    out = []
    for k, (kind, pattern) in enumerate(NAIVE.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            double = [x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(digits))]
            good = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and sum(double) % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.text("0123459.+-@() aZ%é\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert P.base_spans(text) == base_by_hand(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111111111111111", "1.2.3.4", "300.1.1.1", "a.b@c.de", "@", "+1 (017) 555-7713", "+12345678901234", "0", " ", "-", ".", "x"]), max_size=12).map("".join))
def test_base_spans_of_likely_texts(text):
    assert P.base_spans(text) == base_by_hand(text)


def seeded(n=60):
    r = np.random.default_rng(4)
    rows = []
    for k in range(n):
        card = "".join(map(str, r.integers(0, 10, 15)))
        card = next(card + str(x) for x in range(10) if P.luhn(card + str(x)))
        person = [f"ann.{k}@mail{k}.example.com", ".".join(map(str, r.integers(0, 256, 4))), card, f"+1 ({100 + k}) 555-{7000 + k}"][k % 4]
        rows.append((k, f"words before {person} and after {int(r.integers(10**5))}"))
    return rows


def test_field_finds_other_spellings(spark):
    plain = [(100, "write to bob.7(at)mail.example.org now"), (101, "host 10[.]20[.]30[.]40 up"), (102, "ring 1 (017) 555-7713 soon"), (103, "card 4111.1111.1111.1111 ok")]
    clean = [(200, "on 2024-01-31 10:20:30 we had 12345 of 4111.1111.1111.1112"), (201, None), (202, ""), (None, "id 9807915762804491"), (203, "x" * 100_000 + " 1" * 50_000)]
    docs = spark.createDataFrame(seeded() + plain + clean + [(1, seeded()[1][1])], "doc_id long, text string")
    got = {}
    for r in P.find(docs, learn=docs.where("doc_id < 100")).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [got[k][0].spans for k in (100, 101, 102, 103)] == ["email:9:34", "ip:5:22", "phone:5:21", "card:5:24"]
    assert all(got[k][0].spans == "" for k in (200, 201, 202, None, 203)) and len(got[1]) == 2 and got[1][0] == got[1][1]
    for k, text in seeded():
        assert got[k][0].spans == P._said(base_by_hand(text)) != ""
    assert P.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r.spans for r in P.find(spark.createDataFrame(clean[:2], "doc_id long, text string")).collect()] == ["", ""]


def test_gradient_of_the_likelihood():
    texts_ = [t for _, t in seeded(12)]
    rows = []
    for t in texts_:
        for a, b in P.regions(t):
            rows.append((t[a:b], "", "", [(s - a, k, e - a) for s, k, e in P.base_spans(t) if a <= s and e <= b]))
    found, around, gold = P.examples(rows)
    spans = P.candidates(found, around)
    state, whole = P._states(spans, gold)
    keep = np.flatnonzero(whole).tolist()
    spans = P.candidates([found[k] for k in keep], [around[k] for k in keep])
    state, _ = P._states(spans, [gold[k] for k in keep])
    r = np.random.default_rng(0)
    w, m = r.normal(0, 0.3, (spans.features.shape[1], 4)), r.normal(0, 0.3, (5, 5))
    value, dw, dm = P.likelihood(spans, state, P.Field(w, m))
    for x, g in ((w, dw), (m, dm)):
        for _ in range(6):
            at = tuple(int(r.integers(s)) for s in x.shape)
            kept, x[at] = x[at], x[at] + 1e-5
            assert abs((P.likelihood(spans, state, P.Field(w, m))[0] - value) / 1e-5 - g[at]) < 1e-3
            x[at] = kept


def test_best_segmentation_equals_trying_all():
    r = np.random.default_rng(1)
    texts_ = ["1.2.3.4", "+1 5551234567", "a(at)b.c 12345678"]
    spans = P.candidates(texts_, [("", "")] * 3)
    model = P.Field(r.normal(0, 1, (spans.features.shape[1], 4)), r.normal(0, 1, (5, 5)))
    own = spans.features @ model.weights

    def every(region, at, state):
        if at == spans.bound[region + 1]:
            return [(0.0, [])]
        out = [(model.moves[state, 0] + s, x) for s, x in every(region, at + 1, 0)]
        for c in np.flatnonzero(spans.first == at):
            for k in range(4):
                out += [(model.moves[state, k + 1] + own[c, k] + s, [(int(spans.begin[c]), k, int(spans.end[c])), *x]) for s, x in every(region, at + spans.size[c], k + 1)]
        return out

    got = P.best(spans, model)
    assert got == [max(every(k, spans.bound[k], 0), key=lambda x: x[0])[1] for k in range(3)]
