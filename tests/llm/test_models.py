"""Personal data, toxicity, quality, tokens and language on small records."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from notes import odd, prose, records
from pyspark.sql import functions as F

from fleetwake.llm import language, privacy, quality, tokens, toxicity


def plain_spans(text):
    out = []
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and privacy.luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    for k, (pattern, ok) in enumerate(rules):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "") if ok(m.group())]
    return sorted(out)


def test_strict_spans_equal_the_plain_patterns():
    r = random.Random(4)
    letters = "ab.@+-_ 0123459()%\n"
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randrange(60)))
        assert sorted(privacy.base_spans(text)) == plain_spans(text), text


def test_private_spans(spark):
    notes = odd() + [
        ("p", "mail crew.one@buoy.example.org or call +1 (377) 555-0271 now", "x"), ("q", "host 10.0.200.7, card 4111 1111 1111 1111", "x"),
        ("r", "write to mate (at) ship (dot) com", "x"), ("s", "phone (826) 555-4081 today", "x"), ("t", "1" * 60_000 + "@" + "a" * 60_000, "x"),
    ]
    got = privacy.private_spans(records(spark, notes)).collect()
    assert len(got) == len(notes)
    assert sorted((str(x.platform_id), [(s.start, s.kind, s.end) for s in x.spans if s.strict]) for x in got) == sorted((str(k), plain_spans(t)) for k, t, _ in notes)
    found = {x.platform_id: [(s.kind, s.strict) for s in x.spans] for x in got}
    assert (0, False) in found["r"] and (3, False) in found["s"] and found["b"] == []
    assert privacy.private_spans(records(spark, [])).count() == 0


def test_reliabilities_tell_good_labelers_from_bad():
    r = random.Random(8)
    rows = Counter()
    for _ in range(4000):
        y = r.random() < 0.4
        vote = lambda q: "yn"[y == (r.random() > q)]  # noqa: E731  right with probability q
        rows["1" + vote(0.95) + vote(0.9) + vote(0.9) + vote(0.6) + "--" + "2ss"] += 1
    names = sorted(rows)
    p, table = privacy.reliabilities(names, np.array([rows[x] for x in names], float))
    assert table[1, 0, 0] > 0.9 and 0.5 < table[1, 3, 0] < 0.7 and np.abs(p - privacy.classifier(names, np.array([rows[x] for x in names], float), p)).mean() < 0.2


def labelled(n=400):
    """Notes of which a quarter use words on a stem of abuse, disguised in part."""
    r = random.Random(6)
    rows, marks = [], []
    for i in range(n):
        w = prose(1000 + i, 40 + r.randrange(60)).split()
        bad = i % 4 == 0
        for _ in range(6 * bad):
            w[r.randrange(len(w))] = r.choice(["grolfen", "grolfig", "gr0lfa", "іdiot", "STUP1D", "l0ser"])
        rows.append((f"p{i}", " ".join(w), "x"))
        marks.append((f"p{i}", "reject" if bad else "keep"))
    return rows, marks


def test_toxicity_on_held_out_notes(spark):
    rows, marks = labelled()
    reviews = spark.createDataFrame(marks + [("p0", "uncertain"), (None, "keep")], "platform_id string, decision string")
    lexicon = toxicity.fit(records(spark, rows[:250]), reviews)
    got = {x.platform_id: x.predicted for x in toxicity.score(records(spark, rows[250:]), lexicon).collect()}
    assert np.mean([got[k] == (d == "reject") for k, d in marks[250:]]) > 0.97
    scores = toxicity.score(records(spark, odd()), lexicon).collect()
    assert len(scores) == len(odd()) and all(0 <= x.score <= 1 and x.predicted == 0 for x in scores)
    assert toxicity.score(records(spark, []), lexicon).count() == 0


def test_folding_and_exceptions():
    assert toxicity.fold("1D10T іdіоt $tupid cl0wn 2024 lo​ser") == ["idiot", "idiot", "tupid", "clown", "2024", "loser"]
    a = toxicity.Lexicon({}, dict.fromkeys(toxicity.SEEDS, 3.0)).automaton()
    assert toxicity.weigh(toxicity.fold("the trash can and the trash"), a) == (3.0, 6)


def test_signs_at_the_ends_of_words(spark):
    a = toxicity.Lexicon({"ass": 2.0}, dict.fromkeys(toxicity.SEEDS, 3.0)).automaton()
    weigh = lambda t: toxicity.weigh(*(lambda f, e: (f, a, e))(*toxicity.spellings(t)))
    assert [weigh(t)[0] for t in ("$tupid", "a$$ x", "@$$hole", "|oser", "!d!0t", "＄tupid!", "cl0wn$ $cum")] == [3, 2, 2, 3, 3, 3, 6]
    assert [weigh(t)[0] for t in ("@idiot", "idiot$", "$idiot!", "|idiot|", "$5 a$ @ $$ b!", "the tra$h can", "me@$tupid_$")] == [3, 3, 3, 3, 0, 0, 0]
    got = toxicity.weighed(spark.createDataFrame([(1, "$tupid a$$"), (2, None)], "k int, t string"), toxicity.Lexicon({}, {"stupid": 3.0})).collect()
    assert sorted((r.k, r.total, r.n) for r in got) == [(1, 3.0, 2), (2, 0.0, 0)]


def test_toxicity_without_reviews(spark):
    lexicon = toxicity.fit(records(spark, odd()), spark.createDataFrame([], "platform_id string, decision string"))
    assert set(lexicon.words) == set(toxicity.SEEDS)


def plain_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)


def test_quality_counts_and_held_out_accuracy(spark):
    rows = odd() + [("p", "a b c a b c\nx <|>\nx <|>\n \n ü", "x"), ("q", "l1 w\nl1 w\n" * 40, "x")]
    good = [(f"g{i}", prose(i, 80), "x") for i in range(150)]
    junk = [(f"j{i}", " ".join(f"{x}###" for x in prose(500 + i, 80).split()), "x") for i in range(150)]
    marks = [(k, "keep" if k[0] == "g" else "reject") for k, _, _ in good[:100] + junk[:100]]
    model = quality.fit(records(spark, good + junk), spark.createDataFrame(marks, "platform_id string, decision string"))
    got = quality.score(records(spark, rows), model).collect()
    assert sorted([(str(x.platform_id), *tuple(x)[1:7]) for x in got]) == sorted((str(k), *plain_quality(t)) for k, t, _ in rows)
    assert not any(x.kept for x in got if x.base_failed)
    kept = {x.platform_id: x.kept for x in quality.score(records(spark, good[100:] + junk[100:]), model).collect()}
    assert np.mean([kept[k] == (k[0] == "g") for k in kept]) > 0.97
    assert quality.score(records(spark, []), model).count() == 0


def test_quality_without_reviews_keeps_what_passes(spark):
    model = quality.fit(records(spark, odd()), spark.createDataFrame([], "platform_id string, decision string"))
    assert all(x.kept != x.base_failed for x in quality.score(records(spark, odd()), model).collect())


def test_tokens_equal_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    rows = odd() + [("p", "a<|endoftext|>b  <|endoftext|>", "x"), ("q", "  it's\n\n 12345 ünïcode　… \t ", "x"), ("r", "don't 'll we've " * 300, "x")]
    got = tokens.count_tokens(records(spark, rows), definition).collect()
    library = tokens._load(definition)
    want = [(k, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for k, t, _ in rows]
    assert sorted(map(str, (tuple(x) for x in got))) == sorted(map(str, want))
    assert tokens.count_tokens(records(spark, []), definition).count() == 0


def test_dictionaries_learn_the_whole_note(spark):
    rows = [(f"p{i}", prose(1, 200) + " " + " ".join(f"body{chr(97 + j % 26)}" for j in range(i, i + 500)), "en") for i in range(200)]
    known = language.fit(records(spark, rows).withColumnRenamed("provenance", "lang"))
    assert 0.3 < known["en"].count(b"body") * 6 / len(known["en"]) and len(known["en"]) <= 131_072
    short = language.fit(records(spark, [("p", "one short note", "en"), ("q", "", "en")]).withColumnRenamed("provenance", "lang"))
    assert short["en"].strip() == b"one short note"


def test_language_on_held_out_notes(spark):
    r = random.Random(1)
    parts = {"en": "the ing tion er and of that".split(), "de": "der ung sch keit ich und ein".split(), "fr": "le eau ment oui que des eux".split()}
    word = lambda l: "".join(r.choice(parts[l]) for _ in range(r.randrange(1, 4)))
    rows = [(f"{l}{i}", " ".join(word(l) for _ in range(60)), l) for l in parts for i in range(80)]
    known = language.fit(records(spark, [x for x in rows if int(x[0][2:]) < 50]).withColumnRenamed("provenance", "lang"))
    got = {x.platform_id: x for x in language.classify(records(spark, rows), known).collect()}
    test = [k for k, _, _ in rows if int(k[2:]) >= 50]
    assert np.mean([got[k].lang_pred == k[:2] for k in test]) > 0.97 and all(0 <= got[k].score <= 1 for k in test)
    strange = {str(x.platform_id): x for x in language.classify(records(spark, [*odd(), ("digits", "123 456", "x")]), known).collect()}
    assert [strange[k].lang_pred for k in ("a", "b", "c", "digits")] == ["und"] * 4 and strange["a"].rejected
    assert language.classify(records(spark, []), known).count() == 0
    nobody = language.fit(records(spark, odd()).withColumn("lang", F.lit(None).cast("string")))
    assert nobody == {} and {x.lang_pred for x in language.classify(records(spark, rows[:3]), nobody).collect()} == {"und"}
