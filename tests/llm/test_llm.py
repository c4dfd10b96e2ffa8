"""Small cases of every text operator: defined results for nulls, empty and long texts, ties, repeats and clashing names."""

import json
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagewright.llm import common, conversations, cutting, langid, leaks, mojibake, packing, pairs, quality, sentences

EN = "The reader opens the old box and finds a small map in it. Nobody knows who left the map there, but it is old. "
DE = "Der Leser öffnet die alte Kiste und findet darin eine kleine Karte. Niemand weiß, wer die Karte dort gelassen hat. "
FR = "Le lecteur ouvre la vieille boîte et trouve une petite carte. Personne ne sait qui a laissé la carte là. "
RU = "Читатель открывает старый ящик и находит в нём карту. Никто не знает, кто оставил её там. "


def pages(spark, rows):
    return spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(rows)], "page_id long, text string, lang string")


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    rows = []
    for text, lang in ((EN, "en"), (DE, "German"), (FR, "fr-CA"), (RU, "rus")):
        parts = re.findall(r"[^.]+\. ", text)
        rows += [("".join(rng.choices(parts, k=6)), lang) for _ in range(150)]
    return pages(spark, rows)


@pytest.fixture(scope="module")
def models(corpus):
    languages = langid.learn_languages(corpus)
    return languages, sentences.learn_periods(corpus, languages)


# 1 wrong encodings


def test_repairs_known_and_learned_ciphers(spark, corpus):
    damaged = [DE.encode().decode("cp1252"), FR.encode().decode("mac_roman"), RU.encode("koi8-r").decode("cp1251"), RU.encode("cp866").decode("cp1252", "replace"), None, "", "plain", DE, RU, FR + " � "]
    extra = spark.createDataFrame([(1000 + i, t, None) for i, t in enumerate(damaged)], "page_id long, text string, lang string")
    got = {r["page_id"]: r for r in mojibake.repair_encoding(corpus.unionByName(extra)).collect()}
    assert [got[1000 + i]["damage_odds"] > 0 for i in range(10)] == [True, True, True, True, False, False, False, False, False, True]
    assert got[1000]["repaired"] == DE and got[1001]["repaired"] == FR
    letters = sum(a == b for a, b in zip(got[1002]["repaired"], RU)) / len(RU)
    assert letters > 0.85, got[1002]["repaired"]
    assert got[1004]["repaired"] is None and got[1007]["repaired"] == DE
    assert not any(r["damage_odds"] > 0 for i, r in got.items() if i < 1000)


def test_invented_code_page_is_learned_from_its_source(spark):
    rng = random.Random(7)
    parts = ["schön", "für", "Bär", "grün", "müde", "Köln", "Füße", "häus", "lös", "träum", "wär", "süß", "hör", "kühl"]
    vocabulary = [rng.choice(parts) + rng.choice(["er", "en", "lich", "heit", "bar", "ung"]) + rng.choice(["e", "s", "", "n"]) for _ in range(220)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    sound = [(i, "sound", line(1500)) for i in range(300)]
    invented = str.maketrans({"ä": "Ж", "ö": "ђ", "ü": "Љ", "ß": "Ћ"})  # no known page reads these letters this way
    meant = [line(60) for _ in range(3)]
    damaged = [(1000 + i, "odd", t.translate(invented)) for i, t in enumerate(meant)]
    df = spark.createDataFrame(sound + damaged + [(2000, "sound", "The menu icon \ue001 opens the list."), (2001, None, None)], "page_id long, run_id string, text string")
    got = {r["page_id"]: r for r in mojibake.repair_encoding(df, source="run_id").filter("damage_odds > 0").collect()}
    assert set(got) == {1000 + i for i in range(3)}
    assert [got[1000 + i]["repaired"] for i in range(3)] == meant


def test_table_of_a_source_by_em():
    n = np.zeros(mojibake.BUCKETS), np.zeros(mojibake.SINGLE)
    for cells in mojibake._cells(iter(["für müde Bären und schöne Küche " * 50])):
        cells = cells[cells["cell"] >= 0]
        both = np.concatenate(n)
        both[cells["cell"].to_numpy(dtype=int)] += cells["n"].to_numpy()
        n = both[: mojibake.BUCKETS], both[mojibake.BUCKETS :]
    model = mojibake.BigramModel(*n, {}, 0)
    word = "f\u00a5r"  # the known page would say a yen sign is meant
    units = mojibake.split_units(word, "unknown")
    table = mojibake.learn_table([b" ", *units], [*units, b" "], np.full(4, 9.0), "unknown", model)
    assert mojibake.apply_table([word, "x"], "unknown", table) == ["für", None]


def test_encoding_of_an_empty_table(spark, corpus):
    assert mojibake.find_damaged(corpus.limit(0)).count() == 0


# 2 page kinds


def test_kinds_of_own_examples(spark):
    common_words = {"the", "in", "and", "le", "die", "и"}
    at = [quality.FEATURES.index(f) for f in ("entries", "rows", "unreadable", "repeats")]
    got = {k: quality.features(np.array([quality.statistics(t, common_words) for t in texts]))[:, at] for k, texts in quality.EXAMPLES.items()}
    assert (got["prose"] < 0.5).all()
    assert (got["list"][:, 0] > 0.5).mean() > 0.8 and (got["table"][:, 1] > 0.5).mean() > 0.7 and (got["junk"][:, 2:].max(1) > 0.5).mean() > 0.8


def test_mixture_and_edges(spark):
    rows = [(EN + DE, None)] * 8 + [(t, None) for texts in quality.EXAMPLES.values() for t in texts] + [(None, None), ("", None), (" \n ", None), ("## only/heading.txt", None), ("word " * 50_000, None)]
    words = spark.createDataFrame([("en", "the"), ("en", None), ("de", "die")], "lang string, word string")
    got = {r["page_id"]: r["page_kind"] for r in quality.classify_pages(pages(spark, rows), words).collect()}
    n = len(rows)
    assert got[0] == "prose" and [got[i] for i in range(n - 5, n)] == ["junk"] * 5
    assert quality.classify_pages(pages(spark, rows).limit(0), words).count() == 0


def test_page_kind_is_the_kind_of_the_component(spark):
    rng = random.Random(3)
    make = {
        "prose": lambda: " ".join(f"The {rng.choice(['map', 'box', 'rope'])} of the {rng.choice(['reader', 'writer'])} is old and in the house." for _ in range(rng.randint(4, 9))),
        "list": lambda: "\n".join(f"- The {rng.choice(['red', 'blue', 'old'])} {rng.choice(['map', 'box', 'rope'])} was tested on ten roads." for _ in range(rng.randint(5, 12))),
        "table": lambda: "name,size,date\n" + "\n".join(f"box{rng.randint(1, 9)},{rng.randint(1, 99)},2020-01-{rng.randint(10, 28)}" for _ in range(rng.randint(5, 12))),
        "junk": lambda: "\n".join("".join(rng.choice("bcdfgkqxz ") for _ in range(60)) for _ in range(rng.randint(5, 12))),
    }
    rows = [(make[k](), k) for k, n in (("prose", 120), ("list", 40), ("table", 40), ("junk", 40)) for _ in range(n)]
    words = spark.createDataFrame([("en", w) for w in ("the", "of", "is", "and", "in", "was", "on")], "lang string, word string")
    got = quality.classify_pages(pages(spark, rows), words).orderBy("page_id").collect()
    assert sum(r["page_kind"] == k for r, (_, k) in zip(got, rows)) >= 0.97 * len(rows)


def test_mixture_starts_from_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [([float(v) for v in rng.normal(0, 0.1, len(quality.FEATURES))],) for _ in range(6000)] + [([50.0] * len(quality.FEATURES),)]
    monkeypatch.setattr(quality, "ROUNDS", 0)
    model = quality.fit_mixture(spark.createDataFrame(rows, "features array<double>"))
    far = (np.array(rows[-1][0]) - model.mean) / model.scale
    assert min(np.abs(model.center - far).max(1)) < 1e-6 and np.abs(model.center[0]).max() < 1e-6


def test_content_pages(spark):
    df = spark.createDataFrame([("r", 1), ("r", 2), ("r", 3), ("s", 1), (None, 1), (None, 2), (None, 3), ("t", None)], "run_id string, page_no long")
    assert sorted((r["run_id"] or "", r["page_no"]) for r in quality.content_pages(df).collect()) == [("", 2), ("r", 2)]


# 3 conversations

MSG = "msg_id long, run_id string, session long, turn long, role string, text string, prompt_key string, logged_at string, speaker string"


def conversation(spark, rows):
    return spark.createDataFrame([(*r, None, f"2020-01-{i + 1:02d}", "clash") for i, r in enumerate(rows)], MSG)


def test_conversation_automaton(spark):
    ok = [(1, "a", 1, 1, " System\n", "s"), (2, "a", 1, 2, "USER", "q"), (3, "a", 1, 3, "assistant", "r"), (3, "a", 1, 3, "assistant", "r")]
    bad = {
        "gap": [(10, "b", 1, 1, "system", "s"), (11, "b", 1, 2, "user", "q"), (12, "b", 1, 4, "assistant", "r")],
        "twice": [(20, "c", 1, 1, "system", "s"), (21, "c", 1, 2, "user", "q"), (22, "c", 1, 2, "assistant", "r")],
        "role": [(30, "d", 1, 1, "system", "s"), (31, "d", 1, 2, "user", "q"), (32, "d", 1, 3, "tool", "x"), (33, "d", 1, 4, "assistant", "r")],
        "no system": [(40, "e", 1, 1, "user", "q"), (41, "e", 1, 2, "assistant", "r")],
        "no end": [(50, "f", 1, 1, "system", "s"), (51, "f", 1, 2, "user", "q"), (52, "f", 1, 3, "assistant", "r"), (53, "f", 1, 4, "user", "q")],
        "blank": [(60, "g", 1, 1, "system", "s"), (61, "g", 1, 2, "user", " 　"), (62, "g", 1, 3, "assistant", "r")],
        "null": [(70, "h", 1, None, "system", "s"), (71, "h", 1, 2, "user", None), (None, "h", 1, 3, None, "r")],
        "null key": [(80, None, None, 1, "system", "s")],
    }
    m = conversation(spark, ok + [r for rows in bad.values() for r in rows])
    assert {(r["run_id"], r["session"]) for r in conversations.broken_conversations(m).collect()} == {(rows[0][1], rows[0][2]) for rows in bad.values()}
    assert [r["speaker"] for r in conversations.rebuild_conversations(m).orderBy("turn").collect()] == ["system", "user", "assistant"]
    assert conversations.broken_conversations(m.limit(0)).count() == 0


def test_automaton_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 4)
    rows = [(i, "a", 1, i, "system" if i == 1 else "user" if i % 2 == 0 else "assistant", "x") for i in range(1, 12)]
    assert conversations.conversation_states(conversation(spark, rows)).first()["keep"] is True
    assert conversations.conversation_states(conversation(spark, rows[:-1])).first()["keep"] is False
    assert conversations.conversation_states(conversation(spark, rows[:4] + rows[5:])).first()["keep"] is False


def test_requests_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 3)
    roles = ["system", "user", "assistant", "assistant", "assistant", "assistant", "assistant", "assistant", "user", "assistant", "assistant"]
    rows = [(i, "a", 1, i, r, f"{r}{i}") for i, r in enumerate(roles, 1)]
    m = conversation(spark, [*rows, rows[3]])
    got = {r["msg_id"]: r["request"] for df in (pairs._pairs(m).filter("not late"), pairs._late_pairs(m)) for r in df.collect()}
    assert got == {i: "user9" if i > 9 else "user2" for i, r in enumerate(roles, 1) if r == "assistant"}


# 4 pairs


@pytest.mark.parametrize(
    ("text", "form"),
    [(None, "empty"), (" \n", "empty"), ('""', "empty"), ("```json\n```", "empty"), ("null", "empty"), ("{}", "empty"), ('{"action": "", "page": null}', "empty"), ('{"summary": ""}', "empty"), ("[]", "empty"),
     ('{"action": "read_page", "page": 2}', "action"), ('{"summary": "It is."}', "text"), ('{"action": "publish", "identity": {"summary": "cut of', "broken"), ('q?\n{"action": "help"}', "action"), ("notes.txt", "text")],
)
def test_forms(text, form):
    assert pairs.unwrap(text)[0] == form


def test_rules():
    page = "Page 2 of 3:\n\n" + EN
    assert pairs.is_copy(EN, page) and pairs.is_copy(EN.upper(), page) and pairs.is_copy("> What is it good for?", "What is it good for?") and pairs.is_copy("What is it for?\nWhat is it for?", "What is it for?")
    assert not pairs.is_copy(EN[:40], page) and not pairs.is_copy("What is it for?\nIt holds a map and a rope.", "What is it for?") and not pairs.is_copy("", page)
    assert pairs.is_refusal("I'm sorry, but I can't help with that.") and pairs.is_refusal("对不起，关于盒子我不便多说。") and not pairs.is_refusal("I can't help with that. " + EN) and not pairs.is_refusal("I could not find the map, but the box explains it.")
    assert pairs.breaks_off("The map is in the") and pairs.breaks_off("The map is in...") and not pairs.breaks_off("notes.txt, a.md") and not pairs.breaks_off("p12") and not pairs.breaks_off("It is “there.”") and not pairs.breaks_off("他来自远方……")


def test_defects(spark, models):
    def conv(run, *turns):
        roles = ["system", *["user", "assistant"] * 9]
        return [(hash((run, i)) % 10**9, run, 1, i + 1, roles[i], t) for i, t in enumerate(["You answer in English and the reader opens the box.", *turns])]

    q = "Who left the old map in the small box?"
    rows = [*conv("a", q, "Nobody knows who left the map there."), *conv("b", q, None, q, q), *conv("c", q, "Nobody knows who left the m", q, DE), *conv("d", q, "I have to pass on this one.")]
    got = {r["msg_id"]: r["defect"] for r in pairs.find_defects(conversation(spark, rows), models[0]).collect()}
    by_text = {(r[1], r[3]): got.get(r[0]) for r in rows if r[4] == "assistant"}
    assert by_text == {("a", 3): None, ("b", 3): "empty", ("b", 5): "copy", ("c", 3): "truncated", ("c", 5): "other_language", ("d", 3): "refusal"}
    assert pairs.find_defects(conversation(spark, rows).limit(0), models[0]).count() == 0


def test_shortened_versions_and_limits(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab ", k=rng.randint(20, 60))) for _ in range(300)]
    texts += [t[: len(t) - 4] for t in texts[:40]] + [None, "", texts[5]]
    df = spark.createDataFrame([(t,) for t in texts], "body string")
    distinct = sorted({t for t in texts if t})
    want = {t for t, n in zip(distinct, distinct[1:]) if n.startswith(t)}
    known = {r["h"]: r["body"] for r in df.select(F.xxhash64("body").alias("h"), "body").collect()}
    assert {known[r["h"]] for r in pairs.shortened(df).filter("longer").collect()} == want
    cut = spark.createDataFrame([("x" * 50,)] * 40 + [("y" * n,) for n in range(30, 70)], "body string")
    assert [r["size"] for r in pairs.length_limits(cut).collect()] == [50]


def test_cut_behind_a_dot(spark, models):
    start = "Nobody knows who left the old map there, but it was opened on "
    whole = {"ordinal": (start + "den 3.", " Oktober by the reader."), "number": (start + "page 3.", "5 of the book."), "low": (start + "the box etc.", " and so on."), "full": (start + "that day.", " The reader opens the box.")}
    roles = ["system", "user", "assistant"]
    rows = [(n * 10 + i, f"r{n}", 1, i + 1, roles[i], t) for n, b in enumerate([b for a, z in whole.values() for b in (a, a + z)]) for i, t in enumerate(["You answer in English and the reader opens the box.", "Who left the old map in the small box?", b])]
    got = {r["msg_id"]: r["defect"] for r in pairs.find_defects(conversation(spark, rows), models[0]).collect()}
    assert got == {r[0]: "truncated" for r in rows if r[5] in [a for k, (a, _) in whole.items() if k != "full"]}
    assert pairs.unwrap('{"action": "publish", "identity": {"summary": "The map is \\"old\\" and') == ("broken", 'The map is "old" and')
    assert pairs.stops_inside("他来自远", "方。") and not pairs.stops_inside("他来自远方。", "他走了。") and pairs.stops_inside("ฉันไป", "บ้าน") and not pairs.stops_inside("ฉันไป", " บ้าน")


def test_limit_behind_a_dot(spark, models):
    rng = random.Random(4)
    roles = ["system", "user", "assistant"]
    ends = ["".join(rng.choices("abcdefgh ", k=50)).strip().ljust(50, "x") for _ in range(12)] + ["The reader left the old map there and opened it z.", "The reader left the old map there, and opened box."]
    rows = [(n * 10 + i, f"r{n}", 1, i + 1, roles[i], t) for n, b in enumerate(ends) for i, t in enumerate(["You answer in English and the reader opens the box.", "Who left the old map in the small box?", b])]
    assert len(ends[-2]) == len(ends[-1]) == 50
    got = {r["msg_id"]: r["defect"] for r in pairs.find_defects(conversation(spark, rows), models[0]).collect()}
    assert got.get(122) == "truncated" and got.get(132) is None


# 5 languages


def test_languages(spark, corpus, models):
    rows = [(EN * 2, "en"), (EN * 2, "English"), (EN * 2, "fr"), (EN * 2, None), (EN * 2, "unknown"), (EN + DE, "en"), (EN * 2 + "Niemand weiß, wer die Karte dort gelassen hat.", "en"), (None, None), ("", ""), ("1 2 3", None), (RU * 300, "ru-RU")]
    got = {}
    for r in sentences.wrong_labels(pages(spark, rows), *models).collect():
        got.setdefault(r["page_id"], set()).add(r["lang"])
    assert got == {2: {"en"}, 3: {"en"}, 4: {"en"}, 5: {"en", "de"}}
    assert sentences.wrong_labels(pages(spark, rows).limit(0), *models).count() == 0


def test_held_out_accuracy(models):
    known = langid.LanguageModel(*models[0])
    for text, lang in ((EN, "en"), (DE, "de"), (FR, "fr"), (RU, "ru")):
        assert known.best(text.split(". ")[1])[0] == lang
    assert known.best("")[0] is None and sum(c == "de" for c in map(langid.CODES.get, ("de", "deu", "german"))) == 3


# 6 sentences


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("A b cd. Next one! 3.14 is it? ", ["A b cd.", "Next one!", "3.14 is it?"]),
        ("## a/b.txt\nOne line\ngoes on. Two.\n\nNo end", ["## a/b.txt", "One line\ngoes on.", "Two.", "No end"]),
        ("He said “Go. Now.” and left. “Stay!” Then rain.", ["He said “Go. Now.” and left.", "“Stay!”", "Then rain."]),
        ("Wait... is it gone?! Yes; it is.", ["Wait... is it gone?!", "Yes; it is."]),
        ("先解压。再看“语言包。”吗？完了", ["先解压。", "再看“语言包。”", "吗？", "完了"]),
        ("メモには「まず展開する。次に読む。」と書かれています。はい！", ["メモには「まず展開する。次に読む。」と書かれています。", "はい！"]),
        ("เขามา ฉันไป 12 วัน", ["เขามา", "ฉันไป 12 วัน"]),
        ("पहला वाक्य। दूसरा वाक्य।", ["पहला वाक्य।", "दूसरा वाक्य।"]),
        ("", []), (" \n ", []),
    ],
)
def test_boundaries(models, text, want):
    known = langid.LanguageModel(*models[0])
    assert [text[a:b] for a, b in sentences.split_page(text, known, models[1])] == want


def test_learns_abbreviations(spark):
    rng = random.Random(2)
    names = ["Kolar", "Mivad", "Tesun", "Bareq", "Vonil"]
    made = []
    for _ in range(80):
        made.append(" ".join(rng.choice(["The map of Dr. {n} is old.", "Ask Prof. {n} for the map!", "It was on p. {k} of the book.", "Nobody knows the box?", "The rope is new."]).format(n=rng.choice(names), k=rng.randint(1, 99)) for _ in range(8)))
    df = pages(spark, [(t, "en") for t in made])
    languages = langid.learn_languages(df)
    periods = sentences.learn_periods(df, languages)
    assert {a for (_, a), v in periods.items() if "title" in v.split()} >= {"dr", "prof"}
    got = sentences.split_sentences(pages(spark, [("The map of Dr. Mivad is old. Ask Prof. Kolar for the map! The rope is new.", "en"), (None, None)]), languages, periods).collect()
    assert len(got) == 3
    assert sentences.split_sentences(df.limit(0), languages, periods).count() == 0


# 7 packing


@pytest.mark.parametrize("seed", range(6))
def test_plan_fills_without_overlap(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 64, 100])
    counts = {rng.randint(1, cap): rng.randint(1, 60) for _ in range(rng.randint(1, 12))}
    used, seen = {}, {}
    for length, a, b, base, each in packing.plan_slots(counts, cap):
        for r in range(a, b):
            assert r not in seen.setdefault(length, set())
            seen[length].add(r)
            c = base + (r - a) // each
            used[c] = used.get(c, 0) + length
    assert {k: len(v) for k, v in seen.items()} == counts and max(used.values()) <= cap
    least = math.ceil(sum(k * v for k, v in counts.items()) / cap)
    sizes = sorted((k for k, v in counts.items() for _ in range(v)), reverse=True)
    bins: list[int] = []
    for s in sizes:
        fit = [i for i, free in enumerate(bins) if free >= s]
        if fit:
            i = min(fit, key=lambda i: bins[i])
            bins[i] -= s
        else:
            bins.append(cap - s)
    assert least <= len(used) <= max(len(bins) * 1.1 + 1, len(bins))


def test_pack(spark):
    texts = [None, "", "  ", "a b c", "word " * 25, "x " * 10, "x " * 10, "y " * 4]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(5, "x " * 10, "repeat"), (None, "z", None)], "doc_id long, text string, size string")
    got = packing.pack(df, 10).toPandas()
    assert got.groupby("container_id")["size"].sum().max() <= 10 and len(got) == 12
    assert got[got["size"] == 0]["container_id"].isna().all() and sorted(got[got["pieces"] > 1]["size"]) == [5, 10, 10]
    assert packing.pack(df.limit(0), 10).count() == 0 and packing.pack(df.filter("text = ''"), 10).first()["container_id"] is None


# 8 leaks


def test_tiles_equal_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(30):
        a, b = rng.integers(0, 4, 60), rng.integers(0, 4, 25)
        a[10:24] = b[3:17]
        found = leaks.tiles(a, b, 5)
        longest = max((n for i in range(60) for j in range(25) for n in range(1, 26) if i + n <= 60 and j + n <= 25 and (a[i : i + n] == b[j : j + n]).all()), default=0)
        assert max(n for *_, n in found) == longest
        for x in (0, 1):
            marks = np.zeros(60, int)
            for t in found:
                marks[t[x] : t[x] + t[2]] += 1
            assert marks.max() <= 1


def test_leaks(spark):
    item = "the quick brown fox jumps over the lazy dog and then walks home along a quiet river bank"
    zh = "这个很长的段落写着许多不同的汉字而且每个都不一样所以容易认出来"
    words = item.split()
    swapped = [*words[:6], "cat", *words[7:12]]
    docs = {
        1: f"before. {item} after", 2: " ".join(words[:12]).upper().replace(" ", ",\n"), 3: " ".join(words[:11]), 4: " ".join(swapped), 5: "before " + zh[5:25] + " after", 6: zh[5:24],
        7: None, 8: "", 9: " ".join([*words[:4], "x", *words[5:8], "y", *words[9:14]]), 10: "Ｔｈｅ ｑｕｉｃｋ ｂｒｏｗｎ ｆｏｘ ｊｕｍｐｓ ｏｖｅｒ ｔｈｅ ｌａｚｙ ｄｏｇ ａｎｄ ｔｈｅｎ ｗａｌｋｓ", 11: item + " filler " * 2000 + item,
    }
    df = spark.createDataFrame([(k, v, "clash") for k, v in docs.items()] + [(1, docs[1], "repeat")], "doc_id long, text string, hits string")
    items = spark.createDataFrame([(7, item), (8, zh), (9, None), (10, "")], "item_id long, passage string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(df, items).collect()}
    assert got == {(1, 7), (2, 7), (4, 7), (5, 8), (10, 7), (11, 7)}
    assert leaks.find_leaks(df.limit(0), items).count() == 0 and leaks.find_leaks(df, items.limit(0)).count() == 0


# 9 cutting


@pytest.mark.parametrize("seed", range(5))
def test_pieces_cover_the_text(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "Satz. ", "。", "長", "x" * 9, "\n\n", ", ", "中文，", "a-b "]) for _ in range(800))
    limit, overlap = 40, 7
    got, hard = cutting.cut_text(text, limit, overlap)
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    starts, ends = cutting.token_spans(codes)
    assert got[0][0] == starts[0] and got[-1][1] == ends[-1]
    for (a, b, n, _), (c, d, _, _) in zip(got, got[1:]):
        assert n <= limit and a < c < b < d
        assert sum((starts >= c) & (ends <= b)) == overlap
    stretch = max(len(cutting.token_spans(np.frombuffer(s.encode("utf-32-le"), dtype="<u4"))[0]) for s in re.split(r"[\s。！？；，、]+", text) if s)
    assert hard == (stretch > limit)


def test_cutting_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a " * 600, 0), (4, "-" * 700, 0), (5, "a", 0), (3, "a " * 600, 1), (None, "b " * 513, 0)], "doc_id long, text string, piece int")
    got = cutting.cut_documents(df, 512, 64).toPandas()
    assert set(got[got.cut_kind == "hard"].doc_id) == {4} and got["size"].max() <= 512 and got.doc_id.isna().sum() == 2 and len(got[got.doc_id == 3]) == 4
    assert cutting.cut_documents(df.limit(0), 512, 64).count() == 0
    with pytest.raises(ValueError):
        cutting.cut_documents(df, 10, 10)


# shared


def test_first_arrival_and_sizes(spark):
    df = spark.createDataFrame([(1, "b", "2"), (1, "a", "1"), (1, "c", None), (None, "x", "1"), (None, "y", "1")], "k long, v string, t string")
    assert sorted(r["v"] for r in common.first_arrival(df, "k", "t").collect()) == ["a", "x", "y"]
    texts = {"a b": 2, "a.b": 3, "中文a": 3, "$+x": 3, " 　": 0, "don't": 3, None: 0}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", common.token_count(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in got} == texts
    assert isinstance(pd.DataFrame(), pd.DataFrame)


def test_reordered_passage_is_found_by_coverage(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 9)))
    passage = [word() for _ in range(60)]
    tenths = [passage[i : i + 10] for i in range(0, 60, 10)]
    mixed = " ".join(w for i in (3, 0, 5, 2, 4, 1) for w in [*tenths[i], word()])
    docs = spark.createDataFrame([(1, mixed), (2, " ".join(passage[5:25])), (3, " ".join(passage[:9])), (4, "yes " * 400), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(passage)), (8, "yes " * 14), (9, None)], "item_id long, passage string")
    got = {(r["doc_id"], r["item_id"]): (r["leak"], r["coverage"]) for r in leaks.find_leaks(docs, items).collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, 7): "reordered", (2, 7): "stretch", (4, 8): "stretch"} and got[(1, 7)][1] == 1.0


def test_shortened_endings(spark):
    whole = ["The map lies in the old box.", "She found 12 maps in notes.txt today.", "他把旧地图留在盒子里。"]
    cut = ["Nobody knows who lies in the old bo", "We found 7 ma", "没有人把旧地", "Xyzzy plugh qwert"]
    df = spark.createDataFrame([(t,) for t in [*whole, None]], "body string")
    got = pairs.shortened_endings(df, spark.createDataFrame([(t,) for t in cut], "body string"))
    assert {r["body"] for r in got.collect()} == set(cut[:3])
    assert pairs.shortened_endings(df.limit(0), df.limit(0)).count() == 0
    assert pairs.frame('{"action": "read_page", "tags": ["a", "b"], "pa').split()[-3:] == ["]", ",", '"'] and pairs.frame("plain") == ""


def test_without_neighbours_no_reply_is_truncated(spark, models, monkeypatch):
    say = lambda t: json.dumps({"summary": t})
    texts = [EN.split(". ")[0] + ".", EN.split(". ")[1], "The reader opens the old bo", "Nobody knows who left the ma"]
    rows = [(1, 1, 1, "system", "s")] + [x for i, t in enumerate(texts) for x in ((10 * i + 2, 1, 2 * i + 2, "user", "What is in the box?"), (10 * i + 3, 1, 2 * i + 3, "assistant", say(t)))]
    log = spark.createDataFrame([(m, "r", s, t, role, text, None, None) for m, s, t, role, text in rows], "msg_id long, run_id string, session long, turn long, role string, text string, prompt_key string, logged_at timestamp")
    found = lambda: {r["msg_id"]: r["defect"] for r in pairs.find_defects(log, models[0]).collect()}
    assert {k: v for k, v in found().items() if v == "truncated"} == {23: "truncated", 33: "truncated"}
    none = spark.createDataFrame([], "h long, longer boolean, inside boolean")
    monkeypatch.setattr(pairs, "shortened", lambda bodies: none)
    assert "truncated" not in found().values()
