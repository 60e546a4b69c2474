"""Licences over several paragraphs or wrapped lines, inside longer texts."""

import random

import pytest

from tracequarry.llm import license_dice as D

PROSE = "".join(f"Some word{k} of text{k} that say{k} nothing{k} about{k} it{k}.\n\n" for k in range(40))
NOTICES = {"MIT": D._MIT, "BSD-2-Clause": f"{D._BSD_HEAD}\n{D._BSD_TAIL}", "BSD-3-Clause": f"{D._BSD_HEAD}\n{D._BSD_3}\n{D._BSD_TAIL}", "ISC": D._ISC, "Apache-2.0": D._APACHE_HEAD, "GPL-3.0": D._GPL_HEAD.format(v=3), "LGPL-2.1": D._LGPL_HEAD.format(v="2.1"), "AGPL-3.0": D._AGPL_HEAD}


def wrapped(text, width=9):
    w = text.split()
    return "\n".join("# " + " ".join(w[k : k + width]) for k in range(0, len(w), width))


def test_notices_between_paragraphs_and_before_code(spark):
    rows, want = [], {}
    for name, t in NOTICES.items():
        for form in (PROSE + t.replace("\n", "\n\n") + "\n\n" + PROSE, wrapped(t) + "\nimport os\nprint(os.name)\n" + "x = x + 1\n" * 400):
            want[len(rows)] = name
            rows.append((len(rows), form))
    got = {r.doc_id: r for r in D.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.licence for i, r in got.items()} == want and all(r.dice > 0.97 for r in got.values())
    for i in range(0, len(rows), 2):
        lines = rows[i][1].split("\n")
        assert (got[i].first_line, got[i].last_line) == (80, 80 + 2 * NOTICES[want[i]].count("\n")) and len(lines) > 160


@pytest.mark.parametrize("name", D.FULL)
def test_full_texts(name):
    text = dict(D.all_templates()[len(D.TEMPLATES) :])[name]
    m = D.matcher_of(D.all_templates(), D.THRESHOLD)
    begin = PROSE.count("\n")
    hits = [(h[0], h[1], b) for b, e, w in D.units(PROSE + text + "\n\n" + PROSE, m) if e - b > 50 and (h := m.best(w))]
    assert (name, 1.0) in [(n, d) for n, d, b in hits if b >= begin]


def test_two_copies_are_two_runs():
    m = D.matcher_of(D.all_templates(), D.THRESHOLD)
    mit = D._MIT.replace("\n", "\n\n")
    found = m.runs([D.normal_words(x) for x in (mit + "\n\n" + mit + "\n\n" + PROSE).split("\n")])
    assert found == [(0, 5), (6, 11)]


def test_best_run_of_all_ranges():
    rng = random.Random(3)
    template = " ".join(f"w{k % 11}" for k in range(24))
    for threshold in (0.5, 0.8):
        m = D.Matcher((("L", template),), threshold)
        for _ in range(300):
            words = [rng.choice(["q", "r", f"w{rng.randrange(11)}"]) if rng.random() < rng.choice((0.1, 0.4)) else w for w in ["q"] * rng.randint(0, 6) + template.split() + ["r"] * rng.randint(0, 6)]
            cuts = sorted(rng.randint(0, len(words)) for _ in range(rng.randint(0, 12)))
            lines = [words[a:b] for a, b in zip([0, *cuts], [*cuts, len(words)])]
            flat = lambda a, b: D.bigrams([w for x in lines[a:b] for w in x])  # noqa: E731, B023
            dice = lambda a, b: 2 * len(flat(a, b) & m.sets[0]) / (len(flat(a, b)) + len(m.sets[0]))  # noqa: E731, B023
            best = max(dice(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines) + 1))
            found = m.runs(lines)
            assert bool(found) == (best >= threshold)
            if found:
                assert abs(max(dice(a, b) for a, b in found) - best) < 1e-12
