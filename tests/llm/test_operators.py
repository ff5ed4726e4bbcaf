"""Text operators: brute force, exact round trips, held-out cases and edge cases."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import answers, conversations, encoding, endings, language, mixing, overlap, packing, sampling, tokens, transcripts

EDGE_TEXTS = [None, "", "   ", "​", "a", "no " * 5000, "x" * 50_000, "ok"]


# --- 7: sampling


def test_allocate_properties():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(1, 9)
        raw = [rng.random() for _ in range(n)]
        shares = [x / sum(raw) for x in raw]
        avail = [rng.randrange(0, 60) for _ in range(n)]
        total, floors = rng.randrange(0, 120), [rng.randrange(0, 6) for _ in range(n)]
        q = sampling.allocate(total, shares, floors, avail)
        low = [min(f, a) for f, a in zip(floors, avail)]
        assert all(lo <= x <= a for lo, x, a in zip(low, q, avail))
        assert sum(q) == min(max(total, sum(low)), sum(avail))


def test_largest_remainder():
    assert sampling.allocate(10, [0.34, 0.33, 0.33], [0, 0, 0], [99, 99, 99]) == [4, 3, 3]
    assert sampling.allocate(10, [0.98, 0.01, 0.01], [0, 2, 0], [99, 99, 99])[1] == 2


def test_sample_quotas_are_exact_and_repeatable(spark):
    rows = [(i, " Train" if i % 2 else "train", ["a", "B ", "c", None][min(i % 10, 3)], "extra") for i in range(2000)]
    df = spark.createDataFrame(rows, "row_id long, split string, lab string, __split string").withColumn("__key", F.lit(0)).withColumn("label", F.lit(0))
    t = spark.createDataFrame([("train", "a", 0.5, 3, 0.3), ("train", "b", 0.45, 3, 0.3), ("train", "c", 0.05, 3, 0.3), ("dev", "a", 1.0, 1, 0.5)], "split string, lab string, target_share double, min_rows int, sample_frac double")
    s = sampling.draw(df, t, "row_id", "split", "lab")
    rep = {(r["split"], r["lab"]): r for r in s.report.collect()}
    got = s.rows.groupBy(F.trim(F.lower("lab")).alias("l")).count().collect()
    assert {r["l"]: r["count"] for r in got} == {k[1]: r["quota"] for k, r in rep.items() if k[0] == "train"}
    assert rep[("dev", "a")]["available"] == 0
    assert sorted(s.rows.collect()) == sorted(sampling.draw(df, t, "row_id", "split", "lab").rows.collect())
    assert sampling.draw(df.limit(0), t, "row_id", "split", "lab").rows.count() == 0


# --- 8: packing


def test_plan_places_everything_without_overlap():
    rng = random.Random(4)
    for _ in range(40):
        cap = rng.randrange(5, 200)
        hist = {rng.randrange(1, cap + 1): rng.randrange(1, 300) for _ in range(rng.randrange(1, 40))}
        fill, seen = Counter(), Counter()
        for length, rank, items, first, per, off in packing.plan(hist, cap):
            for i in range(items):
                assert rank + i < hist[length]
                seen[length] += 1
                fill[first + i // per] += length
                assert off + (i % per + 1) * length <= cap
        assert seen == Counter(hist) and max(fill.values()) <= cap
        # best fit never needs more than 1.7 times the lower bound
        assert len(fill) <= 1.7 * sum(k * v for k, v in hist.items()) / cap + 1


def test_pack_pieces(spark):
    sizes = [None, 0, 5, 10, 10, 3, 25, 20, 7, 7, 7, 7] * 30
    df = spark.createDataFrame([(i // 2, n, "x") for i, n in enumerate(sizes)], "id long, n int, length string")
    p = packing.pack(df, "id", "n", 10)
    rows = p.pieces.collect()
    assert sum(r["length"] for r in rows) == sum(n or 0 for n in sizes)
    by: dict = {}
    for r in rows:
        if r["container"] is not None:
            by.setdefault(r["container"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for v in by.values():
        end = 0
        for off, n in sorted(v):
            assert off == end
            end = off + n
        assert end <= 10
    assert sorted(r["n_tokens"] for r in p.over_capacity.collect()) == [20] * 30 + [25] * 30
    assert packing.pack(df.limit(0), "id", "n", 10).pieces.count() == 0


# --- 9: mixing


def test_bisected_exponents():
    shares = [0.7, 0.2, 0.1]
    a = mixing.exponent_for_entropy(shares, 1.0)
    assert mixing.entropy(mixing.temperature(shares, a)) == pytest.approx(1.0, abs=1e-6)
    b = mixing.exponent_for_repeats([700, 200, 100], 1000, [1, 2, 2])
    assert all(w * 1000 <= m * t + 1e-6 for w, t, m in zip(mixing.temperature(shares, b), [700, 200, 100], [1, 2, 2]))


def test_budgets_reach_targets_or_caps():
    got = mixing.budgets([100, 100, 800], [0.3, 0.3, 0.4], [1, 5, 2], 1000)
    assert got[0] == 100 and sum(got) == pytest.approx(1000) and all(g <= c + 1e-6 for g, c in zip(got, [100, 500, 1600]))


def test_mix(spark):
    rng = random.Random(5)
    src = {"big": 700, "Small ": 60, "mid": 240, None: 20}
    rows, i = [], 0
    for s, n in src.items():
        for _ in range(n):
            rows.append((i, s, rng.randrange(1, 20), "x"))
            i += 1
    df = spark.createDataFrame(rows, "id long, source string, n int, use_no_ string")
    t = spark.createDataFrame([("big", 0.4, 1), ("small", 0.3, 3), ("mid", 0.2, 1), ("gone", 0.1, 4)], "source string, target_weight double, max_uses int")
    m = mixing.mix(df, t, "id", "source", "n")
    rep = {r["source"]: r for r in m.report.collect()}
    assert rep["gone"]["unreachable"] and rep["small"]["unreachable"] and not rep["big"]["unreachable"]
    uses = m.rows.groupBy("id").agg(F.count("*").alias("c"), F.count_distinct("use_no").alias("d")).collect()
    assert all(r["c"] == r["d"] <= 3 for r in uses)
    for r in rep.values():
        assert abs(r["used_tokens"] - r["budget_tokens"]) <= 20 and r["most_uses"] <= r["max_uses"]
    assert mixing.mix(df.limit(0), t, "id", "source", "n").rows.count() == 0


def test_token_counts(spark):
    enc = tokens.encoder(tokens.VOCABULARY)
    df = spark.createDataFrame([(t,) for t in EDGE_TEXTS], "t string")
    assert [r[0] for r in df.select(tokens.count_tokens(F.col("t"))).collect()] == [len(enc.encode_ordinary(t)) if t else 0 for t in EDGE_TEXTS]
    assert enc.decode(enc.encode_ordinary("Zoë’s café 😂")) == "Zoë’s café 😂"


# --- 5: overlap


def _slow(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return d[-1]


def test_word_distance_equals_dynamic_programming():
    rng = random.Random(6)
    for _ in range(400):
        a = [rng.choice("abcd") for _ in range(rng.randrange(0, 90))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(0, 90))]
        assert overlap.word_distance(a, b) == _slow(a, b)


def test_overlap_equals_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(40)]
    texts = [[rng.choice(vocab) for _ in range(rng.choice([8, 9, 12, 24, 49, 55, 60, 61, 70, 75, 90]))] for _ in range(60)]
    texts += [["no"] * 12, ["no"] * 11 + ["yes"], ["a", "b"] * 6]
    rows = []
    for t in texts:
        rows.append((len(rows), rng.choice(["train", " Train"]), " ".join(t).upper(), "x"))
        for _ in range(2):
            e = list(t)
            for _ in range(rng.randrange(0, len(t) // 6 + 2)):
                at = rng.randrange(len(e))
                e[at : at + rng.randrange(2)] = [rng.choice(vocab)] if rng.random() < 0.7 else []
            rows.append((len(rows), rng.choice(["dev", "test"]), ", ".join(e) + "!", "x"))
    rows += [(len(rows), "train", None, "x"), (len(rows) + 1, None, "w1 " * 9, "x"), (len(rows) + 2, "dev", "too short", "x"), (len(rows) + 3, "dev", rows[0][2], "x")]
    df = spark.createDataFrame(rows, "row_id long, split string, utterance string, id string")
    got = {(r["row_id_a"], r["row_id_b"]) for r in overlap.row_pairs(overlap.find(df, "row_id", "split", "utterance")).collect()}
    w = {r[0]: [x for x in "".join(c if c.isalnum() else " " for c in (r[2] or "").lower()).split()] for r in rows}
    tr = [r[0] for r in rows if (r[1] or "").strip().lower() == "train" and len(w[r[0]]) >= 8]
    ev = [r[0] for r in rows if r[1] in ("dev", "test") and len(w[r[0]]) >= 8]
    want = {(min(a, b), max(a, b)) for a in tr for b in ev if _slow(w[a], w[b]) * 6 <= max(len(w[a]), len(w[b]))}
    assert got == want and len(want) > 40
    assert overlap.row_pairs(overlap.find(df.limit(0), "row_id", "split", "utterance")).count() == 0


# --- 6: conversations


def test_kahn_levels_cycles_and_gaps():
    assert conversations.kahn([0, 1, 2], [None, 0, 1], [(0,), (1,), (2,)]) == [0, 1, 2]
    assert conversations.kahn([0, 1, 2], [None, 2, 1], [(0,), (1,), (2,)]) == [0, -1, -1]
    assert conversations.kahn([0, 2, 3], [None, 1, 2], [(0,), (1,), (2,)]) == [0, -1, -1]
    assert conversations.kahn([0, 1, 1, 2], [None, 0, 0, 1], [(0,), (2,), (1,), (3,)]) == [0, 1, 1, 2]


ROWS = [
    ("ok", 1, "Bo", "fine", 2), ("ok", 0, "Ann", "hi [laughs]", 1), ("ok", 1, " bo", "Fine ", 9), ("gap", 0, "A", "x", 1), ("gap", 2, "B", "y", 2),
    ("null", None, "A", "x", 1), ("null", 0, "B", "x", 1), ("empty", 0, "A", "[door]", 1), ("empty", 2, None, "...", 1), ("rival", 0, "A", "x", 1), ("rival", 0, "B", "x", 2),
    ("mute", 0, None, "x", 1), ("mute", 1, "B", "y", 1), ("single", 0, "A", "x", 1), ("single", 1, "a ", "y", 1), ("silent", 0, "A", "x", 1), ("silent", 1, "B", "(hm)", 1), (None, 0, "A", "x", 1),
]
DEFECTS = {"ok": None, "gap": "broken", "null": "broken", "empty": "empty", "rival": "broken", "mute": "broken", "single": "no_reply", "silent": "no_reply"}


@pytest.mark.parametrize("bound", [100, 0])
def test_conversation_defects(spark, bound):
    df = spark.createDataFrame([(d, t, s, x, i, n, "m") for i, (d, t, s, x, n) in enumerate(ROWS)], "dialog_id string, turn_idx long, speaker string, utterance string, row_id long, at long, says string").withColumn("loaded_at", F.timestamp_seconds("at"))
    c = conversations.rebuild(df, "dialog_id", "turn_idx", "speaker", "utterance", "row_id", "loaded_at", max_in_task=bound)
    assert {r["dialog_id"]: r["defect"] for r in c.status.collect()} == DEFECTS
    ok = [(r["position"], r["speaker"], r["row_id"]) for r in c.messages.filter("dialog_id = 'ok'").orderBy("position").collect()]
    assert ok == [(0, "Ann", 1), (1, "Bo", 0)]
    e = conversations.rebuild(df.limit(0), "dialog_id", "turn_idx", "speaker", "utterance", "row_id", "loaded_at")
    assert e.status.count() == 0 and e.messages.count() == 0


def test_long_chain_by_doubling(spark):
    df = spark.range(300).select(F.lit("d").alias("d"), F.col("id").alias("t"), F.concat(F.lit("s"), F.col("id") % 2).alias("s"), F.lit("x").alias("x"), F.col("id").alias("i"), F.current_timestamp().alias("ts"))
    c = conversations.rebuild(df, "d", "t", "s", "x", "i", "ts", max_in_task=10)
    assert c.status.first()["defect"] is None and c.status.first()["alternates"]
    assert [r["position"] for r in c.messages.orderBy("turn_idx" if "turn_idx" in c.messages.columns else "t").collect()] == list(range(300))


# --- 3: transcripts


def test_transcript_turns(spark):
    cast = spark.createDataFrame([("Tamsin", "Tamsin Kestrelby"), ("Orlando", "Orlando Oxmoor"), ("Umberto", "Umberto Pinderhaugh"), ("Nerissa", "Nerissa Umberfold")], "name string, full_name string")
    nan = float("nan")
    rows = [
        (5, "d", "TAMSIN (O.S.)", 1.0, 2.0, "Um, hello [laughs] there."), (9, "d", "TAMSIN (O.S.)", 1.0, 2.0, "Um, hello [laughs] there."),
        (6, "d", "T. Kestrelby", 4.0, 3.0, "00:03 - you know, again."), (7, "d", None, nan, 9.0, "<00:06.50> Orlando Oxmoor: Yes!"), (8, "d", "Oxmoor, Orlando", 5.0, 5.5, "uh... (coughing)"),
        (10, "d", "Orlnado", 7.0, 8.0, "I guess-- I guess so."), (11, "d", "Tamsin:", None, None, "[7.50] Late."), (12, "d", "Umberto", 20.0, 21.0, None), (13, None, "Umberfold", 1.0, 2.0, "Hi."), (14, "d", "Stranger", 30.0, 31.0, "Who?"),
    ]
    df = spark.createDataFrame(rows, "line_id long, dialog_id string, speaker string, start_sec double, end_sec double, utterance string")
    t = transcripts.rebuild(df, cast, "line_id", "dialog_id", "speaker", "start_sec", "end_sec", "utterance")
    got = [(r["first_line_id"], r["speaker"], r["text"]) for r in t.turns.filter("dialog_id = 'd'").orderBy("turn_no").collect()]
    assert got == [(5, "Tamsin", "hello there. again."), (7, "Orlando", "Yes! I guess so."), (11, "Tamsin", "Late."), (14, "stranger", "Who?")]
    assert [r["speaker"] for r in t.turns.filter("dialog_id = ''").collect()] == ["Nerissa"]
    assert transcripts.rebuild(df.limit(0), cast, "line_id", "dialog_id", "speaker", "start_sec", "end_sec", "utterance").turns.count() == 0


def test_slices_do_not_change_turns(spark):
    cast = spark.createDataFrame([("A", "A Aa"), ("B", "B Bb")], "name string, full_name string")
    rng = random.Random(8)
    rows = [(i, "d", rng.choice("AB"), float(i * 37), float(i * 37 + 1), "word") for i in range(200)]
    df = spark.createDataFrame(rows, "line_id long, dialog_id string, speaker string, start_sec double, end_sec double, utterance string")
    t = transcripts.rebuild(df, cast, "line_id", "dialog_id", "speaker", "start_sec", "end_sec", "utterance").turns
    want = [r[0] for i, r in enumerate(rows) if i == 0 or rows[i - 1][2] != r[2]]
    assert sorted(r["first_line_id"] for r in t.collect()) == want


def test_union_find_keeps_members_apart():
    cast = transcripts.Cast([("Umberto", "Umberto Pinderhaugh"), ("Nerissa", "Nerissa Umberfold")])
    got = transcripts.cluster(["umberto", "umberfold", "umbreto", "u. pinderhaugh", "nerisa"], cast)
    assert got == {"umberto": "Umberto", "umbreto": "Umberto", "u. pinderhaugh": "Umberto", "umberfold": "Nerissa", "nerisa": "Nerissa"}


def _osa(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_similar_labels_are_all_found():
    rng = random.Random(6)
    labels = sorted({"".join(rng.choice("abcå .") for _ in range(rng.randrange(1, 15))) for _ in range(400)})
    near = transcripts.Near(labels)
    for i, x in enumerate(labels):
        true = {y: 1 - _osa(x, y) / max(len(x), len(y)) for y in labels[:i] if abs(len(x) - len(y)) <= 3}
        got = [labels[j] for j in near.before(x, i)]
        assert {y for y, v in true.items() if v >= 0.7} <= set(got) <= set(true)
        assert all(transcripts.similarity(x, y) == v for y, v in true.items())


def test_many_labels_are_clustered_alike(spark):
    members = [("Umberto", "Umberto Pinderhaugh"), ("Nerissa", "Nerissa Umberfold")]
    some = ["umberto pinderhaugh", "u. k. m. w. pinderhaugh", "nerissa", "nerissima", "nerissimaa b"]
    rng = random.Random(7)
    many = {"".join(rng.choice("bcdfghjklqvwxz") for _ in range(9)) for _ in range(6_000)}
    df = spark.createDataFrame([("few", x) for x in some] + [("hot", x) for x in [*some, *many]], "d string, n string")
    rows = transcripts._speakers(df, members).collect()
    assert len(rows) == len(df.collect())
    for d in ("few", "hot"):
        assert [{r["n"]: r["member"] for r in rows if r["d"] == d}[x] for x in some] == ["Umberto", "Umberto", "Nerissa", "Nerissa", "Nerissa"]


# --- 2: encodings

CLEAN = ["The décor is très chic.", "Über-cool, dude.", "I’ve never been so sure…", "Señor Orlando called.", "Ты правда думаешь, что это смешно?", "Może jutro pójdziemy na łąkę.", "São João is not here.", "20 °C and €40", "“Nobody,” she said.", "你好, Tamsin!", "No 😂 way"]


def _model():
    c: Counter = Counter()
    for t in CLEAN * 20:
        for m in encoding._NON_ASCII.finditer(t):
            for i in range(m.start(), m.end()):
                c[encoding._fold(t[i - 1] if i else " ") + t[i]] += 1
                c[t[i] + encoding._fold(t[i + 1] if i + 1 < len(t) else " ")] += 1
    return encoding.Plausibility(c)


def test_round_trips_through_wrong_encodings():
    model, tried = _model(), 0
    for t in CLEAN:
        assert encoding.repair(t, model) == (t, False)
        for enc in ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251"):
            bad = "".join(encoding._table(enc)[1].get(b, chr(b)) for b in t.encode())
            new, found = encoding.repair(bad, model)
            assert found and new == t, (enc, t, bad, new)
            tried += 1
    twice = "café".encode().decode("cp1252").encode().decode("cp1252")
    assert encoding.repair(f"My {twice} here", model) == ("My café here", True)
    assert tried == 5 * len(CLEAN)


def test_search_beyond_its_bounds(monkeypatch):
    model, text = _model(), "My café here"
    for _ in range(6):
        text = text.encode().decode("latin-1")
    assert encoding.search_whole(text, model) == ("My café here", True, True)
    monkeypatch.setattr(encoding, "STATES", 1)
    assert not encoding.search_whole("S\u00c3\u00a3o Jo\u0441 \u00c5\u201eo", model)[2]


POLISH = ["Nie wiem, dlaczego się śmiejesz.", "Dziękuję za śniadanie.", "Lubię cię, naprawdę.", "Książę zgubił świece w łazience.", "Gdzie są moje rękawiczki?", "Śpię, jem i śmieję się."]
FRENCH = ["C’était la fête chez ma tante.", "Très bien, mon frère rêve.", "Une bête, peut-être même deux.", "Le cœur de l’œuvre."]


def test_swapped_letters_without_signs_in_words(spark):
    bad = ["Nie wiem, dlaczego siê œmiejesz.", "Lubiê ciê, naprawdê.", "Œpiê."]
    texts = (POLISH + FRENCH) * 25 + bad
    got = {r["utterance"]: r for r in encoding.find(spark.createDataFrame(list(enumerate(texts)), "row_id long, utterance string"), "row_id", "utterance").rows.collect()}
    assert [(got[t]["garbled"], got[t]["restored"]) for t in bad] == [(True, t.encode("cp1252").decode("cp1250")) for t in bad]
    assert not any(got[t]["garbled"] or got[t]["restored"] != t for t in POLISH + FRENCH)


@pytest.mark.parametrize("times", [1, 1000])
def test_swap_evidence_does_not_fade_with_size(times):
    sound = {k: n * times for k, n in {"iê": 60, "ê ": 60, "ię": 6000, "ę ": 6000, "ñe": 900, "eñ": 900, "ńe": 40, "eń": 40}.items()}
    model = encoding.Plausibility(sound)
    assert encoding.swap("siê ", 1, model, sound) == "się "
    assert encoding.swap("señer", 1, model, sound) is None


def test_garbled_rows_and_edges(spark):
    rows = [(1, "R&amp;B night"), (2, "S�o Jo�o"), (3, "It wasnât me."), (4, "â is a letter, so is Ã."), (5, "CafÃ© &eacute;"), (6, "Wait\x85 what"), *[(10 + i, t) for i, t in enumerate(EDGE_TEXTS)], (None, "CafÃ© &eacute;"), (30, "Le café décoré " * 3_000)]
    df = spark.createDataFrame(rows, "row_id long, utterance string").withColumn("restored", F.lit(1))
    r = {(x["row_id"], x["utterance"]): x for x in encoding.find(df, "row_id", "utterance").rows.collect()}
    assert len(r) == len(rows)
    assert {k[0] for k, x in r.items() if x["garbled"]} == {2, 3, 5, 6, None}
    assert r[(1, "R&amp;B night")]["restored"] == "R&B night" and r[(5, "CafÃ© &eacute;")]["restored"] == "Café é" and not r[(2, "S�o Jo�o")]["complete"]
    assert encoding.find(df.limit(0), "row_id", "utterance").rows.count() == 0


# --- 10 and 1: ends of texts, languages, answers


def _sentence(rng):
    a, n, v = rng.choice(["old", "shy", "rusty", "green"]), rng.choice(["teapot", "cellist", "ladder", "garden"]), rng.choice(["falls", "sings", "waits", "vanishes"])
    return f"{rng.choice(['The', 'Every', 'Our'])} {a} {n} {v} near the {rng.choice(['harbour', 'station', 'museum'])}"


@pytest.fixture(scope="module")
def cut_texts(spark):
    rng = random.Random(9)
    rows = []
    for i in range(1500):
        t = ". ".join(_sentence(rng) for _ in range(3))
        kind = i % 10
        if kind == 0:  # within a word or sentence
            t = t[: len(t) - rng.choice([2, 3, 4, 9, 14, 17])].rstrip()
        elif kind in (1, 2):
            t += rng.choice(["", "…", "\n— Orlando", " :)", " (off)"])
        else:
            t += "."
        rows.append((i, t, "en" if i % 3 else None, "s", kind == 0, "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, truth boolean, cut string")


def test_held_out_truncation(spark, cut_texts):
    t = endings.detect(cut_texts, "doc_id", "text", "lang", "source")
    truth = {r["doc_id"]: r["truth"] for r in cut_texts.collect()}
    got = {r["doc_id"]: r["cut"] for r in t.flags.collect()}
    tp = sum(got[k] and truth[k] for k in got)
    assert tp / sum(truth.values()) > 0.95 and sum(got.values()) - tp < 15
    assert t.report.first()["texts"] == 1500


def test_truncation_edges(spark):
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(EDGE_TEXTS)], "doc_id long, text string, lang string, source string")
    assert endings.detect(df, "doc_id", "text", "lang", "source").flags.count() == len(EDGE_TEXTS)
    assert endings.detect(df.limit(0), "doc_id", "text", "lang", "source").report.count() == 0


LINES = {
    "en": ["the audience would probably feel amused about the teapot", "nobody noticed that the ladder had been hidden in the garden", "she said the golden trophy was hers and left the room"],
    "de": ["die müde bäckerin suchte gestern den schweren spiegel", "der alte geiger verlor beinahe das süße gebäck vor der tür", "niemand weiß warum der hausmeister heimlich lacht"],
    "fr": ["le jardinier joyeux a vendu en secret la valise verte", "la voisine du grenier a cassé sans bruit le vélo", "tout le monde serait confus avant la fête sur le port"],
}


def test_language_classes():
    m = language.Languages({k: v * 10 for k, v in LINES.items()})
    assert m.best("the teapot was hidden in the room")[0] == "en" and m.best("der spiegel vor der tür")[0] == "de"
    assert m.best("Ты правда думаешь")[0] == language.OTHER and m.best("123 !!!") == (language.OTHER, 0.0)


def test_answers(spark):
    rng = random.Random(10)
    ask = "Tell me again which shy tailor oddly labelled the brass wardrobe when the theatre closed for lunch"
    good = [f"{rng.choice(['The audience', 'Listeners', 'Close friends'])} would probably feel {rng.choice(['amused', 'worried', 'curious'])} about the {rng.choice(['teapot', 'ladder', 'garden'])}" for _ in range(600)]
    out = [(i, f"k{i % 50}", g + ("." if i % 5 else "")) for i, g in enumerate(good)]
    bad = {"empty": [None, "", " \n", "N/A", "<eos>", "​"], "refusal": ["I'm sorry, but I can't help with that.", "Request refused by policy.", "As an assistant, it is not possible for me to comment."], "copies_input": [ask.upper() + "?", "Reaction: " + ask], "other_language": ["Die Zuhörer wären vermutlich gerührt vor der Tür.", "Ты правда думаешь, что это смешно?"], "truncated": ["The audience would probably feel", "Listeners would probably fee", "Close friends would probably feel amused about the"]}
    truth = {}
    for kind, texts in bad.items():
        for t in texts:
            truth[len(out)] = kind
            out.append((len(out), "k1", t))
    out += [(len(out), "k2", 'Hearing "I can\'t", listeners would probably feel amused about the ladder.'), (len(out) + 1, None, "Listeners would probably feel worried about the ladder."), (len(out) + 2, "none", good[0] + ".")]
    a = spark.createDataFrame([(*r, "x") for r in out], "ann_id long, iden string, output string, defect string")
    p = spark.createDataFrame([(f"k{i}", ("h: hello", ask, None)) for i in range(50)], "iden string, inputs struct<history string, utterance string, audio string>")
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate((k, ". ".join(v) + ".") for k, v in LINES.items() for _ in range(30))], "doc_id long, text string, lang string")
    r = answers.find(p, a, "iden", "inputs", "ann_id", "output", docs, "text", "lang", "doc_id")
    got = {x["ann_id"]: x["defect"] for x in r.collect()}
    assert len(got) == len(out)
    assert {k: v for k, v in got.items() if v} == truth
    assert answers.find(p, a.limit(0), "iden", "inputs", "ann_id", "output", docs, "text", "lang", "doc_id").count() == 0


def test_refusals_are_not_first_person_denials():
    for t in ["I do not want to lose my brother.", "We won't be late for dinner, I promise.", "I cannot wait to see her!", "No answer can be found in her eyes.", "I can't help laughing about it.", "She refused to answer.", 'He says "I cannot answer that" and leaves.', "I won't describe him as angry, but tense.", None, ""]:
        assert not answers.refuses(t), t
    for t in ["I can't help with that.", "Sorry, I won't speculate about private feelings", "As a language model, I can't provide an answer", "I\u2019d rather not answer that.", "No response can be generated for this prompt.", "I am unable to answer this question.", "Not something I can help with."]:
        assert answers.refuses(t), t


def test_language_of_the_prompt_counts():
    bins = [(True, 0.9 + i / 100, 200) for i in range(-15, 16)] + [(True, -1.0 + i / 10, 1) for i in range(10)] + [(False, 0.9, 5), *((False, -1.0 + i / 10, 5) for i in range(10))]
    at = language.split_points(bins)
    assert -0.1 < at[True] < at[False] < 0.75
    assert language.split_points([]) == {False: float("-inf"), True: float("-inf")}


def test_sentences_and_open_ends():
    done, rest = endings.sentences('He left. "Why?" she asked... The end of it: 3.5 and so on')
    assert done[0] == "he left" and rest.endswith("so on")
    assert endings.open_end(endings.sentences("All is well.")[1]) is None and endings.open_end(" … ") is None
    assert endings.open_end(endings.sentences("All is well. And then we")[1]) == "and then we"


def test_reply_column_shows_cycles(spark):
    rows = [("tree", 0, None, "A", 1), ("tree", 5, 0, "B", 2), ("tree", 9, 0, "B", 3), ("tree", 7, 5, "A", 4), ("loop", 0, None, "A", 1), ("loop", 1, 2, "B", 2), ("loop", 2, 1, "A", 3), ("orphan", 0, None, "A", 1), ("orphan", 1, 8, "B", 2)]
    df = spark.createDataFrame([(d, t, p, s, f"text {i}", i, n) for i, (d, t, p, s, n) in enumerate(rows)], "d string, t long, p long, s string, x string, i long, n long").withColumn("at", F.timestamp_seconds("n"))
    for bound in (100, 0):
        c = conversations.rebuild(df, "d", "t", "s", "x", "i", "at", max_in_task=bound, reply="p")
        assert {r["d"]: r["defect"] for r in c.status.collect()} == {"tree": None, "loop": "broken", "orphan": "broken"}
        got = {r["i"]: r["position"] for r in c.messages.collect()}
        assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0, 5: None, 6: None, 7: 0, 8: None}


def test_levels_of_many_conversations():
    import numpy as np

    rng = random.Random(12)
    conv, key, par, root, want = [], [], [], [], []
    for c in range(60):
        n = rng.randrange(1, 12)
        parents = [None if i == 0 or rng.random() < 0.1 else rng.randrange(0, n + 1) for i in range(n)]
        conv += [c] * n
        key += range(n)
        par += [p or 0 for p in parents]
        root += [p is None for p in parents]
        for i in range(n):
            at, lev, seen = i, 0, set()
            while at is not None and at < n and at not in seen:
                seen.add(at)
                at, lev = parents[at], lev + 1
            want.append(lev - 1 if at is None else -1)
    assert conversations.levels(np.array(conv), np.array(key), np.array(par), np.array(root)).tolist() == want


def test_untimed_and_simultaneous_lines_keep_their_order(spark):
    cast = spark.createDataFrame([("A", "A Aa"), ("B", "B Bb")], "name string, full_name string")
    rng = random.Random(13)
    for times in (lambda i: (None, None), lambda i: (5.0, 6.0)):
        rows = [(i, "d", rng.choice("AB"), *times(i), f"word {i}") for i in range(400)]
        df = spark.createDataFrame(rows, "line_id long, dialog_id string, speaker string, start_sec double, end_sec double, utterance string")
        t = transcripts.rebuild(df, cast, "line_id", "dialog_id", "speaker", "start_sec", "end_sec", "utterance").turns
        want = [r[0] for i, r in enumerate(rows) if i == 0 or rows[i - 1][2] != r[2]]
        assert [r["first_line_id"] for r in t.orderBy("turn_no").collect()] == want


SOUND = ["Zażółć gęślą jaźń.", "Árvíztűrő tükörfúrógép, ütvefúró.", "Pijamalı hasta yağız şoföre çabucak güvendi.", "Příliš žluťoučký kůň úpěl ďábelské ódy.", "À noite, vovô Kowalsky vê o ímã cair no pé do pinguim.", "Съешь же ещё этих мягких булок.", "Où ça ? Là-bas, à l’hôtel — 5 €.", "Fünf Größen für süße Mädchen"]


def test_sound_texts_stay_and_garbled_ones_return(spark):
    # each sound sentence also stands in other rows, as a corpus has its letters more than once
    rows = [t for t in SOUND for _ in range(20)] + ["Za¿ó³æ gêœl¹ jaŸñ.", SOUND[3].encode().decode("cp1250", "replace"), SOUND[5].encode("cp1251").decode("cp1252"), SOUND[7].encode().decode("cp1252")]
    got = {r["utterance"]: r for r in encoding.find(spark.createDataFrame(list(enumerate(rows)), "row_id long, utterance string"), "row_id", "utterance").rows.collect()}
    for t in SOUND:
        assert not got[t]["garbled"] and got[t]["restored"] == t, t
    assert all(got[t]["garbled"] for t in rows[-4:])
    assert got["Za¿ó³æ gêœl¹ jaŸñ."]["restored"] == SOUND[0]
    assert got[rows[-2]]["restored"] == SOUND[5] and got[rows[-1]]["restored"] == SOUND[7]


def test_hot_keys_are_split_without_loss(spark, monkeypatch):
    rng = random.Random(14)
    base = [f"v{i}" for i in range(12)]
    rows = []
    for i in range(60):
        t = list(base)
        t[rng.randrange(12)] = f"x{i}"
        rows.append((i, "train" if i % 2 else "dev", " ".join(t)))
    df = spark.createDataFrame(rows, "row_id long, split string, utterance string")
    whole = {tuple(r) for r in overlap.row_pairs(overlap.find(df, "row_id", "split", "utterance")).select("row_id_a", "row_id_b").collect()}
    monkeypatch.setattr(overlap, "HOT", 3)
    split = {tuple(r) for r in overlap.row_pairs(overlap.find(df, "row_id", "split", "utterance")).select("row_id_a", "row_id_b").collect()}
    assert whole == split == {(min(a, b), max(a, b)) for a in range(0, 60, 2) for b in range(1, 60, 2)}


def test_overlap_moves_less_than_four_times_its_texts(spark):
    rng = random.Random(15)
    rows = [(i, "train" if i % 3 else "test", " ".join(f"word{rng.randrange(200)}" for _ in range(24))) for i in range(6000)]
    near = rows[1][2].split()
    rows.append((6000, "dev", " ".join([*near[:5], "other", *near[6:]])))
    df = spark.createDataFrame(rows, "row_id long, split string, utterance string")
    store = spark.sparkContext._jsc.sc().statusStore()
    before = store.executorSummary("driver").totalShuffleWrite()
    got = [tuple(r) for r in overlap.row_pairs(overlap.find(df, "row_id", "split", "utterance")).select("row_id_a", "row_id_b").collect()]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert got == [(1, 6000)]
    assert store.executorSummary("driver").totalShuffleWrite() - before < 4 * sum(len(r[2]) for r in rows)


def test_cheapest_places_are_cheapest():
    rng = random.Random(16)
    for _ in range(100):
        n = rng.randrange(8, 18)
        parts, cost = n // 5 + 1, [rng.randrange(9) for _ in range(n - 2)]
        at = sorted(overlap._cheapest(np.array([cost]), parts, 3)[0].tolist())
        apart = [c for c in itertools.combinations(range(n - 2), parts) if all(b - a >= 3 for a, b in zip(c, c[1:]))]
        assert tuple(at) in apart and sum(cost[i] for i in at) == min(sum(cost[i] for i in c) for c in apart)
    long_ = overlap._cheapest(np.array([[rng.randrange(9) for _ in range(1001)]]), 201, 3)[0].tolist()
    assert len(long_) == 201 and long_[0] >= 0 and long_[-1] <= 1000 and all(b - a >= 3 for a, b in zip(long_, long_[1:]))


def test_bodies_lose_signs_and_signatures():
    for t, want in [("All is well.\n\u2014 Orlando", "All is well."), ("Fine :) \u2665 (exit) [end of scene]", "Fine"), ("No ***", "No"), ("He left (I think) early", "He left (I think) early"), ("", ""), (" \n", ""), ("a\n- b", "a\n- b")]:
        assert endings.body(t) == want, t
    assert len(endings.body("x" * 200_000 + " ~" * 50_000)) == 200_000


def test_units_and_counts_agree():
    import pandas as pd

    texts = ["The old man sings. The old man", "The shy cat sleeps near the door. The"]
    out = pd.concat(endings._count(iter([pd.DataFrame({"id": [1, 2], "t": texts})])))
    units = out[out["id"].notna()].set_index("id")["units"]
    looked = endings._lookups(pd.Series(sorted({u for x in units for u in x})))
    known = set(out["x"].dropna().astype("int64"))
    assert all(b in known for x in looked for _, _, b, _ in x)
    assert out["e"].dropna().sum() == 2
