"""Repeated runs of sentences against a search in order."""

import random
from collections import Counter

from codexfold.llm.sentence_spans import sentences, without_repeated_spans


def brute(rows, least_words=15):
    """Runs of all lengths, length by length; what occurs once has no longer repeat."""
    places = sorted({(-1 if d is None else d, t or "") for d, t in rows})
    parts = [sentences(text) for _, text in places]
    names: dict = {}
    said = [[names.setdefault(" ".join(text[a:b].split()), len(names)) for a, b, _ in p] for (_, text), p in zip(places, parts)]
    gone = [set() for _ in places]
    runs, n = {(i, k): s for i, p in enumerate(said) for k, s in enumerate(p)}, 1
    while runs:
        n += 1
        longer, names, times = {}, {}, Counter()
        for (i, k), run in sorted(runs.items()):
            if k + n <= len(said[i]):
                longer[i, k] = name = names.setdefault((run, said[i][k + n - 1]), len(names))
                times[name] += 1
        seen, own = {}, set()
        for (i, k), run in longer.items():
            if sum(w for *_, w in parts[i][k : k + n]) >= least_words:
                place = places[i][0]
                if (i, run) in own or seen.get(run, place) < place:
                    gone[i] |= set(range(k, k + n))
                own.add((i, run))
                seen.setdefault(run, place)
        runs = {at: run for at, run in longer.items() if times[run] > 1}
    cut = {}
    for (place, text), p, g in zip(places, parts, gone):
        cut[place, text] = len(p), sorted(g), "".join(text[a:b] for k, (a, b, _) in enumerate(p) if k not in g) if g else text
    out = []
    for d, t in rows:
        n, g, left = cut[-1 if d is None else d, t or ""]
        out.append((d, n, len(g), g, t if t is None else left))
    return sorted(out, key=repr)


def result(frame):
    return sorted(((r.doc_id, r.n_sentences, r.n_removed, list(r.removed), r.text) for r in frame.collect()), key=repr)


def test_documents(small_docs):
    rows, table = small_docs
    assert result(without_repeated_spans(table)) == brute(rows)


def test_edge_cases(docs_of):
    a, b, c = "One two three four five six seven. ", "Eight nine ten eleven twelve thirteen fourteen fifteen! ", "And so on?\n"
    rows = [(None, a + b + c), (1, c + a + b), (1, c + a + b), (1, "Else. " + a + b), (2, None), (3, ""), (4, " \n \n"), (5, a + b + a + b), (6, "." * 100_000),
            (7, "w " * 1000), (8, "w " * 1000 + a), (9, a), (10, a + "Eight nine ten  eleven twelve\tthirteen fourteen fifteen!\n")]
    assert result(without_repeated_spans(docs_of(rows))) == brute(rows)


def every_run(rows, least_words=15):
    """Removed sentences when runs of all lengths are compared."""
    seen, out = {}, {}
    for place, text in sorted(rows):
        parts, gone, own = sentences(text), set(), set()
        for k in range(len(parts)):
            for e in range(k + 2, len(parts) + 1):
                if sum(w for *_, w in parts[k:e]) >= least_words:
                    run = tuple(" ".join(text[a:b].split()) for a, b, _ in parts[k:e])
                    if run in own or seen.get(run, place) < place:
                        gone |= set(range(k, e))
                    own.add(run)
                    seen.setdefault(run, place)
        out[place] = sorted(gone)
    return out


def test_runs_of_all_lengths(docs_of):
    rng = random.Random(5)
    pool = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice([1, 2, 3, 5, 9, 14]))) + ". " for _ in range(60)]
    passages = [[rng.choice(pool) for _ in range(rng.randint(2, 9))] for _ in range(8)]
    rows = [(k, "".join(s for _ in range(5) for s in rng.choice([rng.choice(passages), [rng.choice(pool)]]))) for k in range(60)]
    rows += [(100, "A b c d e f g h i j. K l m n o p q r s t. U v w. Other end."), (101, "A b c d e f g h i j. K l m n o p q r s t. U v w. Unlike words.")]
    found = {r.doc_id: list(r.removed) for r in without_repeated_spans(docs_of(rows)).collect()}
    assert found == every_run(rows) and found[101] == [0, 1, 2]


def test_a_passage_without_sentence_ends_at_another_offset(docs_of):
    rng = random.Random(6)
    draw = lambda n: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(n))
    passage, before = draw(400), draw(17)
    frame = without_repeated_spans(docs_of([(1, f"{draw(60)} {passage} {draw(50)}"), (2, f"{before} {passage} {draw(30)}"), (3, "v " * 500)]))
    left = {r.doc_id: r.text.split() for r in frame.collect()}
    assert len(left[1]) == 510 and len(left[2]) <= 17 + 30 + 2 * 40 and left[2][:17] == before.split()


def test_a_passage_many_share_stays_once(docs_of):
    passage = " ".join(f"Word{k} and more of it here, then an end." for k in range(8))
    frame = without_repeated_spans(docs_of([(k, f"Own start {k} goes here. {passage} Own end {k} comes here.") for k in range(200)]))
    texts = [r.text for r in frame.orderBy("doc_id").collect()]
    assert passage in texts[0] and not any("Word3" in t for t in texts[1:])
    assert all(f"Own start {k} " in t and f"Own end {k} " in t for k, t in enumerate(texts))


def test_sentences_cover_the_text():
    for text in ("A. B! C?\nD", "no end", " lead. x ", "v1.2 is 3.4. Yes", '"Quoted." Next', "w " * 95):
        assert "".join(text[a:b] for a, b, _ in sentences(text)) == text


def test_empty_table(docs_of):
    assert without_repeated_spans(docs_of([]).limit(0)).collect() == []
