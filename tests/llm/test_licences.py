import random
import re

from tallymill.llm import licences


def brute_base(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().lower())
    places = []
    for phrase, label in licences.PHRASES:
        p = phrase.encode().split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(places)


def test_base_as_brute_force():
    scanner, rng = licences.Scanner(), random.Random(5)
    vocabulary = "under the mit license apache version 2 cc by nc x licensed é9 this work is".split()
    for _ in range(400):
        text = rng.choice([" ", "-", ", "]).join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))
        text += rng.choice(["", " under the MIT License", " CC BY-NC", " Apache License, Version 2.0"])
        n, places = brute_base(text)
        got = scanner.scan(text.encode())
        assert (got["n_words"], got["n_base"]) == (n, len(places)), text
        assert got["first_word"] == (places[0][0] if places else None) and got["last_word"] == (places[-1][0] if places else None)
        assert got["base_labels"] == ",".join(sorted({x[1] for x in places})) and set(got["base_labels"].split(",")) - {""} <= set(got["labels"].split(","))


def test_matching_statistics_as_brute_force():
    templates = (("x", "a b c d a b"), ("y", "b c d e f"))
    scanner = licences.Scanner(templates, (), least=2, share=0.5)
    sources, rng = [t.encode().split() for _, t in templates], random.Random(1)
    pieces = {tuple(s[i:j]) for s in sources for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(300):
        words = [rng.choice(b"a b c d e f g".split()) for _ in range(rng.randrange(20))]
        best = [max((n for n in range(1, i + 2) if tuple(words[i + 1 - n : i + 1]) in pieces), default=0) for i in range(len(words))]
        want = [(i + 1, n) for i, n in enumerate(best) if n >= 2 and not (i + 1 < len(words) and best[i + 1] == n + 1)]
        assert [(e, n) for e, n, _ in scanner.matches(words)[0]] == want, words


def test_spans_and_chains():
    scanner = licences.Scanner()
    notice = licences.TEMPLATES[1][1]
    words = notice.split()
    got = scanner.scan(("intro words " + " ".join([*words[:20], "INSERTED", *words[20:]]) + " outro").encode())
    assert got["labels"] == "mit" and got["score"] > 0.9 and got["n_base"] == 0
    span = next(s for s in got["spans"] if s["label"] == "mit")
    assert span["start"] == 2 and span["stop"] >= 2 + len(words)
    assert scanner.scan(b"the software of the cat")["labels"] == ""


def test_operator(docs, none):
    rows = licences.scan(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert next(r for r in rows if r["doc_id"] == 9)["base_labels"] == "apache-2,cc-by-nc,mit"
    assert next(r for r in rows if r["doc_id"] == 2)["n_words"] == 0
    assert licences.scan(none).count() == 0


def brute_chain(template, words, least):
    """The most words of the template that a chain of its maximal matches can cover, tried exhaustively."""
    pieces = []
    for i in range(len(words)):
        for j in range(i + least, len(words) + 1):
            for c in range(len(template) - (j - i) + 1):
                whole = words[i:j] == template[c : c + j - i]
                longer = (i and any(words[i - 1 : j] == template[k : k + j - i + 1] for k in range(len(template)))) or (j < len(words) and any(words[i : j + 1] == template[k : k + j - i + 1] for k in range(len(template))))
                if whole and not longer:
                    pieces.append((i, j, c, c + j - i))
    pieces.sort()

    def grown(last, sum_):
        out = [sum_]
        for i, j, c, d in pieces:
            if (i, j, c, d) > last and last[1] < j and last[3] < d and i - last[1] <= len(template):
                out.append(grown((i, j, c, d), sum_ + d - max(c, last[3])))
        return max(out)

    return max((grown(p, p[3] - p[2]) for p in pieces), default=0)


def test_chains_as_brute_force():
    rng = random.Random(3)
    for _ in range(120):
        template = [rng.choice(b"a b c d e f".split()) for _ in range(rng.randrange(4, 10))]
        words = [rng.choice([*template, b"x"]) for _ in range(rng.randrange(12))]
        scanner = licences.Scanner((("t", " ".join(w.decode() for w in template)),), (), least=2, share=0.5)
        found = scanner.chains(scanner.matches(words)[0])
        got = max((g for ended in found.values() for g, _, _ in ended), default=0)
        assert got == brute_chain(template, words, 2), (template, words)


def test_ends_are_all_places():
    rng = random.Random(8)
    for _ in range(40):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(3)]
        auto = licences.Automaton(sequences)
        for n, own in enumerate(sequences):
            for i in range(len(own)):
                for j in range(i + 1, len(own) + 1):
                    state = 0
                    for token in own[i:j]:
                        state = auto.next[state][token]
                    want = sorted((m, k + j - i) for m, other in enumerate(sequences) for k in range(len(other) - (j - i) + 1) if other[k : k + j - i] == own[i:j])
                    assert sorted(auto.ends(state)) == want


def test_a_notice_twice_and_related_licences():
    scanner = licences.Scanner()
    gpl = next(t for label, t in licences.TEMPLATES if label == "gpl" and "version 3" in t)
    got = scanner.scan(f"one {gpl} two three {gpl} four".encode())
    n = len(licences.words_of(gpl.encode()))
    assert [(s["start"], s["stop"]) for s in got["spans"]] == [(1, 1 + n), (3 + n, 3 + 2 * n)] and got["labels"] == "gpl"
    lgpl = next(t for label, t in licences.TEMPLATES if label == "lgpl")
    assert scanner.scan(lgpl.encode())["labels"] == "lgpl"


def test_large_inventory_in_linear_time():
    import time
    import tracemalloc

    rng, common = random.Random(2), " ".join(f"c{i}" for i in range(400))
    made = [(f"l{n}", " ".join([common, *(f"w{rng.randrange(3000)}" for _ in range(2600))])) for n in range(200)]
    took, held = [], []
    for k in (50, 200):
        tracemalloc.start()
        licences.Scanner(tuple(made[:k]), ())
        held.append(tracemalloc.get_traced_memory()[0])
        tracemalloc.stop()
        began = time.process_time()
        scanner = licences.Scanner(tuple(made[:k]), ())
        took.append(time.process_time() - began)
    assert held[1] < 6 * held[0] and took[1] < 10 * took[0] + 2
    assert len(scanner.auto.link) <= 2 * sum(scanner.sizes)
    got = scanner.scan(made[7][1].encode())
    assert got["labels"] == "l7" and got["score"] == 1.0


def test_templates_from_a_table(spark, docs):
    table = spark.createDataFrame([("own", "one two three four five six"), ("own", None), (None, "x y")], "label string, text string")
    own = licences.templates_of(table)
    assert own == (("own", "one two three four five six"),)
    rows = spark.createDataFrame([(1, "zero one two three four five six seven")], "doc_id long, text string")
    assert licences.scan(rows, own).first()["labels"] == "own"
    import pytest

    with pytest.raises(ValueError):
        licences.templates_of(table, most_words=3)
