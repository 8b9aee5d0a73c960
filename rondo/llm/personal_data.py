"""Personal data: base patterns, and a semi-Markov conditional random field over the places where such data may stand.

Base spans are e-mail addresses, internet addresses, card numbers and phone numbers of fixed patterns, always
reported. The field adds what these miss: addresses written with ``(at)``, spaced or bracketed dots, phone numbers without their plus,
cards with dots between the groups.

A region is a run of words with a digit, ``@`` or a bracketed ``at``, joined by single spaces; it ends at the first space
after REGION_SOFT characters, at REGION_HARD characters at the latest. Its atoms are runs of digits or of letters and single
other characters. A segmentation of a region cuts it into spans of at most MAX_ATOMS atoms of one of the four kinds and
single atoms outside. Features look at a whole span (digits, groups, check sum, parts above 255, ends, neighbours);
dynamic programming over spans of bounded length finds the best segmentation, which settles borders and kinds at once.

The weights are fitted by the likelihood of segmentations (forward and backward sums) on a bounded sample: of the base
matches at most FIT_REGIONS regions a kind and twice as many without a match, those of least hash, each text once. A
matched region is taken again in two of the spellings that the patterns miss, cards and internet addresses also with a wrong
digit or part and then without a span, and some plain numbers are added; so the labels come from the patterns alone.

Defined cases: null and empty texts have no spans; an empty table gives no rows; without a region to learn from nothing is
added; repeated rows count each; a null id keeps its row; long texts are read whole; columns other than doc_id and text
are not read. An added span never overlaps a base one.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rondo.llm.common import map_arrow_all

KINDS = ("email", "ip", "card", "phone")
MAX_ATOMS, MAX_CHARS = 16, 64
REGION_SOFT, REGION_HARD = 192, 256
FIT_REGIONS, FIT_ATOMS, STEPS = 100, 24, 60

#: Fixed patterns of the contract; a run is taken whole, which no match of them can differ from.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_DIGIT = re.compile(r"[0-9]")
_SEED = re.compile(r"[0-9@]|[(\[][aA][tT][)\]]")
_SPACE = re.compile(r"\s")
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|[^A-Za-z0-9]", re.DOTALL)


def luhn(digits: str) -> bool:
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    stop, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > stop and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            stop = found.end()
            yield begin, stop
        at = text.find("@", max(at + 1, stop))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, by start and kind; each kind's are leftmost and don't overlap."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def regions(text: str) -> list[tuple[int, int]]:
    """(start, end) of the regions of a text, from left to right."""
    out: list[tuple[int, int]] = []
    seed = _SEED.search(text)
    while seed:
        at, last = seed.start(), out[-1][1] if out else 0
        begin = at
        while begin > max(last, at - MAX_CHARS) and not text[begin - 1].isspace():
            begin -= 1
        space = _SPACE.search(text, at)
        end = min(space.start() if space else len(text), at + REGION_HARD)
        end = max(end, seed.end())
        if out and begin == last + 1 and text[last] == " " and last - out[-1][0] < REGION_SOFT and end - out[-1][0] <= REGION_HARD:
            out[-1] = (out[-1][0], end)
        else:
            out.append((begin, end))
        seed = _SEED.search(text, end)
    return out


# kinds of atoms
_D, _A, _S, _AT, _PLUS, _OPEN, _CLOSE, _DOT, _DASH, _ELSE = range(10)
_SIGN = {"@": _AT, "+": _PLUS, "(": _OPEN, "[": _OPEN, ")": _CLOSE, "]": _CLOSE, ".": _DOT, "-": _DASH}


@dataclass(frozen=True)
class Spans:
    """Candidate spans of some regions: first atom, number of atoms, features; ``bound`` are the regions' first atoms.

    ``begin`` and ``end`` are the places of each span's characters in its region.
    """

    bound: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    size: np.ndarray
    features: np.ndarray


def candidates(texts: list[str], around: list[tuple[str, str]]) -> Spans:
    """The spans that have seven digits or one ``@`` or ``at`` at least, and whole-span features of them."""
    kind, length, digits, big, word, bound, place = [], [], [], [], [], [0], []
    stream: list[str] = []
    for text in texts:
        at = 0
        for atom in _ATOM.findall(text):
            c = atom[0]
            k = _D if "0" <= c <= "9" else _A if c.isascii() and c.isalpha() else _S if c.isspace() else _SIGN.get(c, _ELSE)
            kind.append(k)
            length.append(len(atom))
            digits.append(len(atom) if k == _D else 0)
            big.append(k == _D and (len(atom) > 3 or int(atom) > 255))
            word.append(k == _A and atom.lower() == "at")
            place.append(at)
            at += len(atom)
            if k == _D:
                stream.append(atom)
        bound.append(len(kind))
    n = len(kind)
    kind, length, bound = np.array(kind, np.int64), np.array(length, np.int64), np.array(bound)
    total = lambda x: np.concatenate([[0], np.cumsum(np.asarray(x, np.int64))])
    at_digit, at_char, at_big, at_word = total(digits), total(length), total(big), total(word)
    of = [total(kind == k) for k in range(10)]
    # the check sum of any run of digits: digits of the last one's parity as they are, the others doubled
    value = np.frombuffer("".join(stream).encode(), np.uint8).astype(np.int64) - 48
    double = np.where(value > 4, 2 * value - 9, 2 * value)
    parity = np.arange(len(value)) % 2
    sums = np.stack([total(np.where(parity == p, value, double)) for p in (0, 1)])

    region_end = np.repeat(bound[1:], np.diff(bound))
    first = np.repeat(np.arange(n), MAX_ATOMS)
    size = np.tile(np.arange(1, MAX_ATOMS + 1), n)
    some = first + size <= (np.repeat(region_end, MAX_ATOMS) if n else 0)
    first, size = first[some], size[some]
    last = first + size - 1
    diff = lambda x: x[last + 1] - x[first]
    nd, ats, words = diff(at_digit), diff(of[_AT]), diff(at_word)
    good = np.isin(kind[first], (_D, _A, _PLUS, _OPEN)) & np.isin(kind[last], (_D, _A)) & (diff(at_char) <= MAX_CHARS) & ((nd >= 7) | (ats + words > 0))
    first, size, last = first[good], size[good], last[good]
    nd, ats, words = nd[good], ats[good], words[good]
    groups, dots, letters, chars = diff(of[_D]), diff(of[_DOT]), diff(of[_A]), diff(at_char)
    over = diff(at_big)
    stop = at_digit[last + 1]
    check = (nd >= 14) & (nd <= 19)
    sound = check & ((sums[(stop - 1) % 2, stop] - sums[(stop - 1) % 2, at_digit[first]]) % 10 == 0) if len(value) else check
    # the atoms, or characters, beside the span
    region = np.repeat(np.arange(len(texts)), np.diff(bound))[first]
    outer = np.array([[_edge(a), _edge(b)] for a, b in around], np.int64).reshape(-1, 2)
    before = np.where(first > bound[region], kind[np.maximum(first - 1, 0)], outer[region, 0])
    after = np.where(last + 1 < bound[region + 1], kind[np.minimum(last + 1, max(n - 1, 0))], outer[region, 1])
    address = (ats + words == 1) & (letters > 0) & (kind[last] == _A) & (dots > 0)
    four = (groups == 4) & (dots == 3) & (letters == 0)
    no_letters = letters == 0
    columns = [
        np.ones(len(first)), nd < 7, (nd >= 7) & (nd < 10), (nd >= 10) & (nd < 14), (nd >= 14) & (nd < 16), (nd >= 16) & (nd <= 19), nd > 19,
        sound, check & ~sound, sound & no_letters, ats == 1, (ats == 0) & (words == 1), ats + words > 1, address, address & (diff(of[_ELSE]) == 0),
        four, four & (over == 0), four & (over > 0), no_letters, letters > words, diff(of[_ELSE]) > 0, diff(of[_S]) > 0, diff(of[_S]) > 4,
        kind[first] == _PLUS, kind[first] == _OPEN, kind[first] == _A, kind[last] == _A, groups == 1, (groups == 2) | (groups == 3), groups == 4, groups > 4,
        diff(of[_OPEN]) == 1, diff(of[_OPEN]) != diff(of[_CLOSE]), diff(of[_DASH]) > 0, dots > 0, (dots > 0) & no_letters, (groups == 1) & no_letters,
        np.isin(before, (_D, _A)), np.isin(after, (_D, _A)), np.isin(before, (_DOT, _DASH, _PLUS, _AT)), np.isin(after, (_DASH, _AT)), after == _OPEN, before == _OPEN, chars > 40,
        (nd >= 10) & (nd <= 13) & no_letters & (diff(of[_OPEN]) == 1),
    ]
    place = np.array(place, np.int64)
    return Spans(bound, place[first], place[last] + length[last], first, size, np.stack([np.asarray(c, np.float64) for c in columns], 1))


def _edge(c: str) -> int:
    return _S if not c or c.isspace() else _D if "0" <= c <= "9" else _A if c.isalpha() else _SIGN.get(c, _ELSE)


_STATES = 1 + len(KINDS)  # state 0 is a single atom outside


@dataclass(frozen=True)
class Field:
    """Weights (features x kinds) of spans and (states x states) of neighbours; an atom outside scores 0."""

    weights: np.ndarray
    moves: np.ndarray


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


def likelihood(spans: Spans, gold: np.ndarray, model: Field) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log likelihood of the segmentations and its gradients; ``gold`` holds the state of each span that is in one, else 0.

    Forward and backward sums run over all regions at once, atom by atom.
    """
    bound, n_regions = spans.bound, len(spans.bound) - 1
    atoms = np.diff(bound)
    width = int(atoms.max(initial=0))
    region = np.searchsorted(bound, spans.first, "right") - 1
    start = spans.first - bound[region]
    score = np.full((n_regions, width, MAX_ATOMS, _STATES), -np.inf)
    own = spans.features @ model.weights
    score[region, start, spans.size - 1, 1:] = own
    score[:, :, 0, 0] = np.where(np.arange(width) < atoms[:, None], 0.0, -np.inf)
    ahead = np.full((n_regions, width + 1, _STATES), -np.inf)  # best sums that end at an atom in a state
    ahead[:, 0, 0] = 0.0  # before the region: outside
    came = np.full((n_regions, width + 1, _STATES), -np.inf)  # the same with the move to the next state
    came[:, 0] = _sum_exp(ahead[:, 0, :, None] + model.moves, 1)
    for j in range(1, width + 1):
        sizes = np.arange(1, min(j, MAX_ATOMS) + 1)
        ahead[:, j] = _sum_exp(came[:, j - sizes] + score[:, j - sizes, sizes - 1], 1)
        came[:, j] = _sum_exp(ahead[:, j, :, None] + model.moves, 1)
    total = _sum_exp(ahead[np.arange(n_regions), atoms], 1)
    back = np.full((n_regions, width + 1, _STATES), -np.inf)
    back[np.arange(n_regions), atoms] = 0.0
    go = np.full((n_regions, width + 1, _STATES), -np.inf)  # sums from an atom on, by the state of the next span
    for j in range(width - 1, -1, -1):
        sizes = np.arange(1, min(width - j, MAX_ATOMS) + 1)
        go[:, j] = _sum_exp(score[:, j, sizes - 1] + back[:, j + sizes], 1)
        here = _sum_exp(go[:, j, None, :] + model.moves, 2)
        back[:, j] = np.where((j < atoms)[:, None], here, back[:, j])
    inside = np.exp(came[region, start] + score[region, start, spans.size - 1] + back[region, start + spans.size] - total[region, None])[:, 1:]
    target = np.eye(_STATES)[gold][:, 1:]
    grad = spans.features.T @ (target - inside) / n_regions
    live = np.arange(width) < atoms[:, None]
    with np.errstate(invalid="ignore"):
        expected = np.exp(ahead[:, :width, :, None] + model.moves + go[:, :width, None, :] - total[:, None, None, None])
    expected = np.where(live[:, :, None, None], expected, 0.0).sum((0, 1))
    seen = np.zeros((_STATES, _STATES))
    value = -total.sum()
    chosen = np.flatnonzero(gold)
    value += float(own[chosen, gold[chosen] - 1].sum())
    for r in range(n_regions):
        state, j = 0, 0
        mine = {int(start[c]): c for c in chosen[region[chosen] == r]} if len(chosen) else {}
        while j < atoms[r]:
            c = mine.get(j)
            following = int(gold[c]) if c is not None else 0
            seen[state, following] += 1
            state, j = following, j + (int(spans.size[c]) if c is not None else 1)
    value += float((seen * model.moves).sum())
    return value / n_regions, grad, (seen - expected) / n_regions


def best(spans: Spans, model: Field) -> list[list[tuple[int, int, int]]]:
    """For each region the spans (start, kind, end) of its best segmentation; regions without a span that could gain are skipped."""
    score = spans.features @ model.weights
    region = np.searchsorted(spans.bound, spans.first, "right") - 1
    may = score + 2 * max(0.0, float(model.moves.max() - model.moves.min())) > 0
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(spans.bound) - 1)]
    for r in np.unique(region[may.any(1)]).tolist():
        base, n = int(spans.bound[r]), int(spans.bound[r + 1] - spans.bound[r])
        low, high = np.searchsorted(region, [r, r + 1])
        starts: list[list[int]] = [[] for _ in range(n + 1)]
        for c in range(low, high):
            if may[c].any():
                starts[int(spans.first[c] - base + spans.size[c])].append(c)
        reached = np.full((n + 1, _STATES), -np.inf)
        reached[0, 0] = 0.0
        back: dict[tuple[int, int], tuple[int, int, int]] = {}  # atom and state before, and the span
        for j in range(1, n + 1):
            step = reached[j - 1] + model.moves[:, 0]
            back[j, 0] = (j - 1, int(step.argmax()), -1)
            reached[j, 0] = step.max()
            for c in starts[j]:
                i = j - int(spans.size[c])
                step = reached[i][:, None] + model.moves[:, 1:]
                value = step.max(0) + score[c]
                for k in np.flatnonzero(value > reached[j, 1:]).tolist():
                    reached[j, k + 1] = value[k]
                    back[j, k + 1] = (i, int(step[:, k].argmax()), c)
        j, state = n, int(reached[n].argmax())
        while j > 0:
            j, before, c = back[j, state]
            if state:
                out[r].append((int(spans.begin[c]), state - 1, int(spans.end[c])))
            state = before
        out[r].reverse()
    return out


#: Spellings of each kind that the patterns miss: what to find in a match, what to write.
_SPELLINGS = (
    (("@", "(at)"), ("@", " @ ")),
    ((r"\.", "[.]"), (r"\.", " . ")),
    ((None, "."), (None, "/")),
    ((r"\+", ""), (r"\+[0-9]{1,3}[ -]?", "")),
)


def _respelled(text: str, span: tuple[int, int, int], which: int) -> tuple[str, tuple[int, int, int]]:
    a, kind, b = span
    old, new = _SPELLINGS[kind][which]
    if old is None:  # groups of four digits
        digits = text[a:b].replace(" ", "").replace("-", "")
        body = new.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    else:
        body = re.sub(old, new, text[a:b])
    return text[:a] + body + text[b:], (a, kind, a + len(body))


#: Numbers that are nobody's, as they are written.
_NUMBERS = (
    "2024-01-31", "2024-01-31 10:20:30", "31/01/2024", "31.01.2024 10:20", "10:20:30", "1999-2003", "3.14159265", "12,345,678", "1 234 567 890",
    "978-3-16-148410-0", "v1.22.333.4444", "1.2.3.4.5", "300.400.500.600", "12345678", "1234567890123", "0x1234567890abcdef", "user@", "@1234567", "(2024) 12-34",
)


def _unsound(text: str, span: tuple[int, int, int]) -> str:
    """A card with another last digit, or an address with parts above 255: no personal data."""
    a, kind, b = span
    body = text[a : b - 1] + str((int(text[b - 1]) + 5) % 10) if kind == 2 else ".".join(str(256 + int(x) * 2) for x in text[a:b].split("."))
    return text[:a] + body + text[b:]


def examples(rows: list[tuple[str, str, str, list]]) -> tuple[list[str], list[tuple[str, str]], list[list[tuple[int, int, int]]]]:
    """Regions with their neighbours and spans (start, kind, end), the matched ones respelled and made unsound, and plain numbers."""
    texts, around, gold = [], [], []
    for text, left, right, spans in rows:
        free: list[tuple[int, int, int]] = []
        for x in sorted((tuple(s) for s in spans), key=lambda s: (s[0], -s[2])):  # no overlap: the first, then the longest
            if not free or x[0] >= free[-1][2]:
                free.append(x)
        versions = [(text, free)]
        if len(free) == 1:
            if free[0][1] in (1, 2):
                versions.append((_unsound(text, free[0]), []))
            for version, other in [(text, free[0])] + [(t, free[0]) for t, s in versions[1:]]:
                for which in (0, 1):
                    t, s = _respelled(version, (other[0], other[1], other[2] + len(version) - len(text)), which)
                    versions.append((t, [s] if version == text else []))
        for t, s in versions:
            texts.append(t)
            around.append((left, right))
            gold.append(s)
    for text in _NUMBERS:
        texts.append(text)
        around.append((" ", " "))
        gold.append([])
    return texts, around, gold


def _states(spans: Spans, gold: list[list[tuple[int, int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """The state of each candidate span in the given segmentations, and the regions whose spans are all candidates."""
    region = np.searchsorted(spans.bound, spans.first, "right") - 1
    known = {x: c for c, x in enumerate(zip(region.tolist(), spans.begin.tolist(), spans.end.tolist(), strict=True))}
    state, whole = np.zeros(len(region), np.int64), np.ones(len(gold), bool)
    for r, own in enumerate(gold):
        for a, kind, b in own:
            c = known.get((r, a, b))
            if c is None:
                whole[r] = False
            else:
                state[c] = kind + 1
    return state, whole


def fit_field(rows: list[tuple[str, str, str, list]], steps: int = STEPS) -> Field | None:
    """Maximum likelihood by adaptive gradient steps with a small penalty; None without a matched region."""
    texts, around, gold = examples(rows)
    spans = candidates(texts, around)
    _, whole = _states(spans, gold)
    fits = whole & (np.diff(spans.bound) <= FIT_ATOMS) & (np.diff(spans.bound) > 0)
    pick = np.flatnonzero(fits).tolist()
    if not any(gold[r] for r in pick):
        return None
    gold = [gold[r] for r in pick]
    spans = candidates([texts[r] for r in pick], [around[r] for r in pick])
    state, _ = _states(spans, gold)
    x = [np.zeros((spans.features.shape[1], len(KINDS))), np.zeros((_STATES, _STATES))]
    first, second = [np.zeros_like(v) for v in x], [np.zeros_like(v) for v in x]
    for k in range(1, steps + 1):
        _, *grad = likelihood(spans, state, Field(*x))
        for i, g in enumerate(grad):
            g = g - 1e-4 * x[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            x[i] = x[i] + 0.3 * (first[i] / (1 - 0.9**k)) / (np.sqrt(second[i] / (1 - 0.99**k)) + 1e-8)
    return Field(*x)


def sample(docs: DataFrame, most: int = FIT_REGIONS) -> list[tuple[str, str, str, list]]:
    """(region, left, right, spans): at most ``most`` regions a kind of base match and twice as many of none, of least hash.

    A task hands on its own least ones only; the driver gets so many regions of each class and no more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        least: list[dict[int, tuple]] = [{} for _ in range(_STATES)]
        edge = [1 << 64] * _STATES
        for batch in batches:
            for scalar in batch.column(0):
                text = scalar.as_py()
                if not _SEED.search(text):
                    continue
                base = base_spans(text)
                for a, b in regions(text):
                    inner = [(s - a, k, e - a) for s, k, e in base if a <= s and e <= b]
                    kind = inner[0][1] if inner else len(KINDS)
                    key = xxhash.xxh64_intdigest(text[a:b])
                    if key < edge[kind]:
                        least[kind][key] = (text[a:b], text[a - 1 : a] if a else "", text[b : b + 1], inner)
                        if len(least[kind]) >= 4 * most:
                            least[kind] = {k: least[kind][k] for k in heapq.nsmallest(2 * most, least[kind])}
                            edge[kind] = max(least[kind])
        rows = [(kind, key, row) for kind, own in enumerate(least) for key, row in heapq.nsmallest(2 * most, own.items())]
        yield {
            "kind": [k for k, _, _ in rows], "key": [key - (1 << 63) for _, key, _ in rows], "region": [x[0] for _, _, x in rows], "left": [x[1] for _, _, x in rows],
            "right": [x[2] for _, _, x in rows], "spans": [[list(s) for s in x[3]] for _, _, x in rows],
        }

    rows = map_arrow_all(docs.select(F.coalesce("text", F.lit("")).alias("text")), run, "kind int, key long, region string, left string, right string, spans array<array<int>>")
    rows = rows.groupBy("kind", "key").agg(F.min(F.struct("region", "left", "right", "spans")).alias("x"))
    out = []
    for kind in range(_STATES):
        own = rows.where(F.col("kind") == kind).orderBy("key").limit(most * (2 if kind == len(KINDS) else 1)).collect()  # bounded
        out += [(r["x"]["region"], r["x"]["left"], r["x"]["right"], r["x"]["spans"]) for r in own]
    return out


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _apart(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that overlap none of ``base``, by search in the running ends of these."""
    if not base:
        return spans
    ends = np.maximum.accumulate([e for _, _, e in base])
    place = np.searchsorted([s for s, _, _ in base], [x[2] for x in spans], "left")  # base spans that begin before the span's end
    return [x for x, k in zip(spans, place.tolist(), strict=True) if k == 0 or ends[k - 1] <= x[0]]


#: Regions that are scored together.
_TOGETHER = 256


def find(docs: DataFrame, model: Field | None = None, learn: DataFrame | None = None) -> DataFrame:
    """op12: (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added); the field is fitted on ``learn``, or on ``docs``."""
    field = model or fit_field(sample(docs if learn is None else learn))

    def added(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        own = regions(text)
        out = []
        for k in range(0, len(own), _TOGETHER):
            some = own[k : k + _TOGETHER]
            spans = candidates([text[a:b] for a, b in some], [(text[a - 1 : a] if a else "", text[b : b + 1]) for a, b in some])
            out += [(at + a, kind, at + b) for (at, _), found in zip(some, best(spans, field), strict=True) for a, kind, b in found]
        return _apart(out, base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            counts, digests, said, more = [[] for _ in KINDS], [], [], []
            for scalar in batch.column(1):
                text = scalar.as_py()
                seeded = _SEED.search(text)
                base = base_spans(text) if seeded else []
                extra = added(text, base) if seeded and field else []
                for k, own in enumerate(counts):
                    own.append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(_said(base).encode()).hexdigest())
                said.append(_said(sorted(base + extra)))
                more.append(len(extra))
            yield {"doc_id": batch.column(0), "base_sha256": digests, "spans": said, "n_added": more} | {f"n_{k}": c for k, c in zip(KINDS, counts, strict=True)}

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return map_arrow_all(rows, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
