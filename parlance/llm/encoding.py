"""Problem 2: text that was decoded with a wrong character encoding."""

from __future__ import annotations

import heapq
import html
import math
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.runtime import bounded_rows, cut_lineage, spread

#: Encodings that UTF-8 bytes may have been read in, and (read in, meant) pairs of single-byte encodings.
MISREAD = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8_r", "cp866", "cp1253", "cp1254")
SWAPPED = (("cp1252", "cp1250"), ("cp1252", "cp1251"), ("cp1252", "cp1253"), ("cp1252", "iso8859_2"), ("cp1252", "koi8_r"), ("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("cp437", "cp1252"), ("cp1250", "cp1252"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"))
#: Price of reading as UTF-8 (well-formed by accident hardly ever), of another single-byte encoding, of an unescape, gain that a changed text must bring, states looked at, operations in a row.
STEP, SWAP, UNESCAPE, GAIN, STATES, DEEPEST = 0.2, 1.5, 0.1, 0.1, 400, 4
#: Price of a nat of context evidence.
NAT = 0.3
#: Texts that one task searches.
TEXTS_A_TASK = 500
#: Prices of places and words that a worker keeps.
KNOWN = 200_000
#: Code points up to which context counts are kept; the table has at most LAST^2 rows.
LAST = 0x530
_NON_ASCII = re.compile(r"[^\x00-\x7f]+")
_TOKEN, _WORD = re.compile(r"[^\W\d_]+"), re.compile(r"[^ \t\r\n]+")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")
_TABLES: dict[str, tuple[dict[str, int], dict[int, str]]] = {}
_SETS: dict[str, tuple[frozenset, frozenset, frozenset]] = {}


def _table(enc: str) -> tuple[dict[str, int], dict[int, str]]:
    """char -> byte and byte -> char of a single-byte encoding; undefined bytes stand for the control of that number."""
    if enc not in _TABLES:
        there = {}
        for b in range(128, 256):
            try:
                there[b] = bytes([b]).decode(enc)
            except UnicodeDecodeError:
                there[b] = chr(b)
        back = {c: b for b, c in there.items()}
        if enc in ("cp1252", "cp1254"):  # control characters that a lenient reader let through
            for b in range(0x80, 0xA0):
                back.setdefault(chr(b), b)
        _TABLES[enc] = back, there
    return _TABLES[enc]


def _bytes_of(enc: str) -> tuple[frozenset, frozenset, frozenset]:
    """Characters that stand for lead bytes of UTF-8, for those that follow, and for any byte above ASCII."""
    if enc not in _SETS:
        back = _table(enc)[0]
        _SETS[enc] = tuple(frozenset(c for c, b in back.items() if lo <= b <= hi and c > "\x7f") for lo, hi in ((0xC2, 0xF4), (0x80, 0xBF), (0x80, 0xFF)))
    return _SETS[enc]


def as_utf8(text: str, enc: str) -> str:
    """Every well-formed UTF-8 sequence that a run of characters spells in ``enc`` is decoded, the rest stays."""
    back, _ = _table(enc)

    def run(m: re.Match) -> str:
        chars = m[0]
        raw = bytes(back.get(c, 0) for c in chars)
        if 0 not in raw and (whole := _UTF8.fullmatch(raw)):
            return raw.decode("utf-8")
        out, i = [], 0
        while i < len(chars):
            if (hit := _UTF8.match(raw, i)):
                out.append(hit[0].decode("utf-8"))
                i = hit.end()
            else:
                out.append(chars[i])
                i += 1
        return "".join(out)

    return _NON_ASCII.sub(run, text)


def as_other(text: str, enc: str, meant: str) -> str:
    """Words put back to bytes of ``enc`` and read as ``meant``.

    A wrong reading explains every character of a word, so a word with one outside ``enc`` was not read in it and stays.
    So does one whose letters beside letters would become signs, other than an apostrophe between letters.
    """
    back, (_, there) = _table(enc)[0], _table(meant)

    def word(m: re.Match) -> str:
        w = m[0]
        if w.isascii() or any(c > "\x7f" and c not in back for c in w):
            return w
        new = "".join(c if c < "\x80" else there[back[c]] for c in w)
        for i, (c, n) in enumerate(zip(w, new)):
            if c > "\x7f" and c.isalpha() and not n.isalpha():
                before, after = w[i - 1 : i].isalpha(), w[i + 1 : i + 2].isalpha()
                if (before or after) and not (n == "’" and before and after):
                    return w
        return new

    return _WORD.sub(word, text)


def as_windows(text: str) -> str:
    """C1 controls, which no text has, as the characters of the Windows code page at those places."""
    _, there = _table("cp1252")
    return re.sub("[\x80-\x9f]", lambda m: there[ord(m[0])], text)


_ESCAPES = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]+);|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}")


def unescape(text: str) -> str:
    return _ESCAPES.sub(lambda m: html.unescape(m[0]) if m[0][0] == "&" else chr(int(m[0][2:], 16)), text)


#: Typographic marks that are ordinary in running text, and Cyrillic letters beyond the Russian ones.
_MARKS = frozenset("’‘“”„–—…«»¿¡€£§°·•′″")
_LEADS = frozenset("âÂÃ")
_SCRIPTS = {"LATIN": "L", "CYRILLIC": "C", "GREEK": "G", "CJK": "J", "HIRAGANA": "J", "KATAKANA": "J", "HANGUL": "H", "ARABIC": "A", "HEBREW": "E", "DEVANAGARI": "D", "THAI": "T"}
_KINDS: dict[str, tuple[str, str, float]] = {}


def kind(c: str) -> tuple[str, str, float]:
    """(category, script, price) of a character."""
    if (got := _KINDS.get(c)) is None:
        cat, o = unicodedata.category(c), ord(c)
        script = _SCRIPTS.get(unicodedata.name(c, "").split(" ")[0], "-")
        if o < 128:
            price = 0.0
        elif c == "�":
            price = 6.0
        elif cat in ("Cc", "Co", "Cn", "Cs"):
            price = 5.0
        elif cat == "Cf":
            price = 2.0
        elif cat[0] == "L" and script == "L":
            price = 0.4 if o < 0x180 else 0.3 if 0x1E00 <= o < 0x1F00 else 1.2
        elif cat[0] == "L" and script == "C":
            price = 0.15 if 0x410 <= o <= 0x44F or o in (0x401, 0x451) else 0.8
        elif cat[0] == "L" and script == "G":
            price = 0.15
        elif cat[0] == "L":
            price = 0.25 if script != "-" else 1.0
        elif c in _MARKS:
            price = 0.3
        elif c == "\xa0":
            price = 0.5
        elif 0x2500 <= o < 0x25A0:
            price = 3.0
        elif o >= 0x1F000:
            price = 0.6
        elif cat in ("Sm", "So", "Sc", "Sk", "No"):
            price = 1.0
        else:
            price = 1.0
        got = cat, script, price
        if len(_KINDS) < 100_000:
            _KINDS[c] = got
    return got


class Plausibility:
    """Cost of a text: prices of its characters, of odd neighbours, mixed scripts and contexts rare in the corpus."""

    def __init__(self, contexts: dict[str, int]):
        self.contexts = contexts
        self.places: dict[str, float] = {}
        self.tokens: dict[str, tuple[frozenset, float]] = {}

    def cost(self, text: str) -> float:
        if text.isascii():
            return 0.0
        total, places = 0.0, self.places
        padded = f" {text} "
        for m in _NON_ASCII.finditer(padded):
            for i in range(m.start(), m.end()):
                near = padded[i - 1 : i + 2]
                got = places.get(near)
                if got is None:
                    got = self._place(*near)
                    if len(places) < KNOWN:
                        places[near] = got
                total += got
        scripts: set[str] = set()
        for w in _TOKEN.findall(text):
            if w.isascii():
                scripts.add("L")
                continue
            found = self.tokens.get(w)
            if found is None:
                found = self._token(w)
                if len(self.tokens) < KNOWN:
                    self.tokens[w] = found
            scripts |= found[0]
            total += found[1]
        return total + 0.8 * max(0, len(scripts - {"-"}) - 1)

    def _place(self, a: str, c: str, b: str) -> float:
        """The price of a character between two others."""
        cat, script, total = kind(c)
        ka, kb = kind(a)[0][0], kind(b)[0][0]
        if c in _LEADS and ord(b) > 0x7F and kb != "L" and b not in "’”»…":
            total += 1.5
        if cat[0] == "L":
            if cat == "Lu" and a.islower() and ka == "L":
                total += 2.0
        elif cat[0] == "M" and script not in ("-", kind(a)[1]):  # a mark of another script than its letter
            total += 3.0
        elif cat != "Zs" and c not in "’'·" and cat[0] != "M":
            # marks and signs within a word, or glued to the next one without a blank
            if ka == "L" and kb == "L":
                total += 2.0
            elif (ka == "L") != (kb == "L") and cat[0] in "SN" and c not in "€£°½¼¾":
                total += 1.0
            elif kb == "L" and c in "¿¡" and ka not in "ZPC":
                total += 1.0
        seen = self.contexts.get(_fold(a) + c, 0) + self.contexts.get(c + _fold(b), 0) if ord(c) < LAST else 50
        return total + max(0.0, 1.2 - NAT * math.log1p(seen))

    @staticmethod
    def _token(w: str) -> tuple[frozenset, float]:
        """The scripts of a word, and the price of mixing them and of too many odd letters."""
        own = frozenset(kind(c)[1] for c in w)
        total = 3.0 * (len(own) - 1)
        odd = sum(1 for c in w if 0xC0 <= ord(c) < 0x250)
        return own, total + (1.0 * odd if odd > 2 and odd > 0.6 * len(w) else 0.0)


def _fold(c: str) -> str:
    """A neighbour for context counts: letters in lower case, all else by class."""
    k = kind(c)[0][0]
    return (c.lower() if ord(c) < LAST and len(c.lower()) == 1 else "x") if k == "L" else {"Z": " ", "P": ".", "N": "0"}.get(k, "#")


def repair(text: str, model: Plausibility) -> tuple[str, bool]:
    """The cheapest text; whether the way there decodes again."""
    return search_whole(text, model)[:2]


def search_whole(text: str, model: Plausibility) -> tuple[str, bool, bool]:
    """As ``repair``, and whether the search came to its end.

    A search that stops at its bounds goes on from the best text, as long as that gets cheaper.
    """
    decoded = False
    while True:
        new, dec, at_bound, whole = _search(text, model)
        decoded |= dec
        if new == text or (whole and not at_bound):
            return new, decoded, whole
        text = new


def _search(text: str, model: Plausibility) -> tuple[str, bool, bool, bool]:
    """Best-first search for the cheapest text; whether the way there decodes again (unescaping alone does not), whether
    it has as many operations as are looked at, and whether no way that could be cheaper was left when states ran out.

    States are texts; visited ones are kept by hash. A text of n characters costs O(n) a state, and at most STATES states
    are looked at.
    """
    # escapes are undone first: that is never dearer
    text = unescape(text)
    heap: list[tuple[float, int, int, str, bool, float]] = [(model.cost(text), 0, 0, text, False, 0.0)]
    start = heap[0][0]
    seen, best, n = {hash(text)}, (start, text, False, 0), 0
    while heap and n < STATES:
        at, _, depth, now, decoded, spent = heapq.heappop(heap)
        n += 1
        if depth >= DEEPEST:
            continue
        slack = float(max(1, len(_NON_ASCII.findall(now))))
        ways: list[tuple[Callable[[], str], bool, float]] = [(lambda: unescape(now), decoded, UNESCAPE)]
        if not now.isascii():
            ways.append((lambda: as_windows(now), True, STEP))
            # a way that has no character to work on changes nothing
            high = {c for c in now if c > "\x7f"}
            ways += [(partial(as_utf8, now, e), True, STEP) for e in MISREAD if not (_bytes_of(e)[0].isdisjoint(high) or _bytes_of(e)[1].isdisjoint(high))]
            ways += [(partial(as_other, now, e, m), True, SWAP) for e, m in SWAPPED if not _bytes_of(e)[2].isdisjoint(high)]
        for make, dec, price in ways:
            # no text costs less than 0: a way dearer than the best text cannot lead to a better one
            if spent + price >= best[0]:
                continue
            new = make()
            if new == now or (h := hash(new)) in seen:
                continue
            seen.add(h)
            c, paid = model.cost(new), spent + price
            if c + paid < best[0] - 1e-9:
                best = (c + paid, new, dec, depth + 1)
            # ways that only make it worse are not followed: a step between may cost some more for every damaged place
            if c <= at - spent + slack:
                heapq.heappush(heap, (c + paid, n, depth + 1, new, dec, paid))
    whole = not any(e[5] + UNESCAPE < best[0] for e in heap)
    if best[2] and start - best[0] < GAIN:
        return text, False, False, whole
    return best[1], best[2], best[3] >= DEEPEST, whole


def _pairs(text: str, i: int) -> tuple[str, str]:
    """The contexts of a character: with the neighbour before it, and with the one behind it."""
    return _fold(text[i - 1] if i else " ") + text[i], text[i] + _fold(text[i + 1] if i + 1 < len(text) else " ")


def swap(text: str, rows: int, model: Plausibility, sound: dict[str, int]) -> str | None:
    """The text as another single-byte encoding has it, if the contexts of restored texts tell so, else null.

    Only letters that become letters within words count: a wrong letter costs as much as the right one, so the log-odds
    of their contexts decide, summed over the whole text: ratios, which do not fade as tables grow. ``sound`` counts
    contexts over the rows of all restored texts; the ``rows`` of this text do not testify for it.
    """
    own: dict[str, int] = {}
    for m in _NON_ASCII.finditer(text):
        for i in range(m.start(), m.end()):
            for p in _pairs(text, i):
                own[p] = own.get(p, 0) + rows
    log = lambda p: math.log(max(sound.get(p, 0) - own.get(p, 0), 0) + 0.5)
    letter = lambda c: kind(c)[0][0] == "L"
    best, at = (-GAIN, None), None
    for e, meant in SWAPPED:
        new, odds = as_other(text, e, meant), 0.0
        for m in _NON_ASCII.finditer(text):
            for i in range(m.start(), m.end()):
                if new[i] != text[i] and letter(new[i]) and letter(text[i]) and (letter(text[i - 1 : i] or " ") or letter(text[i + 1 : i + 2] or " ")):
                    odds += sum(map(log, _pairs(new, i))) - sum(map(log, _pairs(text, i)))
        if NAT * odds <= SWAP:
            continue
        at = model.cost(text) if at is None else at
        best = min(best, (SWAP + model.cost(new) - at - NAT * odds, new), key=lambda x: x[0])
    return best[1]


#: What is left of a mark of three bytes whose last two were dropped: a lone letter within or between English words.
_LOST = re.compile(r"[a-z]â(?:s|d|re|ve|ll)\b|nât\b|\bIâ(?:m|d|ve|ll)\b|(?<=[A-Za-z.,!?] )â(?= [A-Za-z])|[âÃÂ][\xa1-\xaa\xac-\xba\xbc-\xbf€]|[a-z]â(?=[A-Z])|[a-z]{2}â(?![\w])|(?<!\w)â(?=[A-Z])|(?<!\w)Ã(?= ?[a-z])")
_BROKEN = re.compile("[\x80-\x9f�]")


@dataclass
class Repair:
    rows: DataFrame


def contexts(texts: DataFrame, text: str, rows: Column | None = None) -> dict[str, int]:
    """Counts of (neighbour, character) pairs around characters above ASCII and below LAST, over all texts (or their rows)."""

    @F.pandas_udf("array<string>")
    def pairs(s: pd.Series) -> pd.Series:
        def one(t: str) -> list[str]:
            out = []
            for m in _NON_ASCII.finditer(t or ""):
                for i in range(m.start(), m.end()):
                    if ord(t[i]) < LAST:
                        out += _pairs(t, i)
            return out

        return s.map(one)

    counts = texts.filter(F.col(text).rlike(r"[^\x00-\x7F]")).select(F.explode(pairs(text)).alias("p"), (F.lit(1) if rows is None else rows).alias("n")).groupBy("p").agg(F.sum("n").alias("count"))
    return {r["p"]: r["count"] for r in bounded_rows(counts, LAST * LAST * 2, "the context table")}


def find(df: DataFrame, id_col: str, text_col: str) -> Repair:
    """Every row with its restored text and whether it was decoded with a wrong encoding.

    ``restored`` is the cheapest text reachable from the whole value by encoding, decoding and unescaping; ``garbled``
    tells that decoding was needed, or that signs of a wrong decoding remain which cannot be undone (replacement and C1
    control characters, remains of dropped bytes): ``complete`` is then false, as it is where the search ran out of states. HTML entities alone are unescaped but
    are not garbled. Null texts stay null and are not garbled; so are texts in ASCII without escapes, which are not
    searched. Equal texts are searched once and get equal results; repeated rows and ids are kept. The search counts
    contexts over distinct texts. Letters of another single-byte encoding are then told by contexts over the rows of all
    restored texts (``swap``). Extra columns are not carried. An empty table gives an empty result.
    """
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))
    texts = cut_lineage(rows.filter("__t is not null").filter(F.col("__t").rlike(r"[^\x00-\x7F]|&[#A-Za-z0-9]+;|\\[ux][0-9a-fA-F]")).groupBy("__t").agg(F.count(F.lit(1)).alias("__n")))
    model = Plausibility(contexts(texts, "__t"))

    @F.pandas_udf("new string, garbled boolean, whole boolean")
    def search(s: pd.Series) -> pd.DataFrame:
        out = []
        for t in s:
            new, decoded, whole = search_whole(t, model)
            out.append((new, decoded or bool(_BROKEN.search(t)), whole))
        return pd.DataFrame(out, columns=["new", "garbled", "whole"])

    # a fixed number of partitions, for the search is long and its rows are short; written once, or filters on the result
    # would be pushed below the exchange and inferred for the other side of the join, searching every text again
    found = cut_lineage(spread(texts, TEXTS_A_TASK).select(F.col("__t").alias("__ft"), "__n", search("__t").alias("r")).select("__ft", "__n", "r.*"))
    news = cut_lineage(found.groupBy("new").agg(F.sum("__n").alias("m")))
    sound = contexts(news, "new", F.col("m"))

    @F.pandas_udf("restored string, swapped boolean, lost boolean")
    def finish(s: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for t, m in zip(s, n):
            other = swap(t, m, model, sound)
            new = t if other is None else other
            out.append((new, other is not None, bool(_BROKEN.search(new) or _LOST.search(new))))
        return pd.DataFrame(out, columns=["restored", "swapped", "lost"])

    last = cut_lineage(spread(news, TEXTS_A_TASK).select("new", finish("new", "m").alias("f")).select("new", "f.*"))
    found = found.join(last, "new").select("__ft", F.struct("restored", (F.col("garbled") | F.col("swapped") | F.col("lost")).alias("garbled"), (F.col("whole") & ~F.col("lost")).alias("complete")).alias("r"))
    out = rows.join(found, F.col("__t") == F.col("__ft"), "left")
    return Repair(out.select(F.col("__id").alias(id_col), F.col("__t").alias(text_col), F.coalesce("r.restored", "__t").alias("restored"), F.coalesce("r.garbled", F.lit(False)).alias("garbled"), F.coalesce("r.complete", F.lit(True)).alias("complete")))
