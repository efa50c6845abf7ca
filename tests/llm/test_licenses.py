"""License scans against plain sets of bigrams."""

import re

from tandem.llm import licenses

from .edge import ROWS, frame

MORE = [
    (50, "before\nReleased under the MIT License.\nafter"), (51, "licensed   UNDER the apache license version 2.0"), (52, licenses.TEMPLATES[-2][1]),
    (53, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.\nReleased under the MIT License."), (54, "mit"), (55, "Released under a very free License."),
]


def bigrams(text):
    w = re.findall("[a-z0-9]+", text)
    return set(zip(w, w[1:]))


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute(text):
    t = low(text)
    units = [*t.split("\n"), t] if "\n" in t else [t]
    best = {}
    for i, u in enumerate(units):
        a = bigrams(u)
        for name, template in licenses.TEMPLATES:
            b = bigrams(low(template))
            dice = 2 * len(a & b) / (len(a) + len(b))
            if dice >= licenses.THRESHOLD - 1e-12:
                best[i, name] = max(best.get((i, name), 0), dice)
    return len(units), sorted((i, n, round(d, 9)) for (i, n), d in best.items())


def test_matches_equal_plain_sets(spark):
    rows = ROWS + MORE
    got = licenses.licence_scan(frame(spark, rows)).collect()
    have = sorted(((r.doc_id, r.n_units, sorted((m.unit, m.name, round(m.dice, 9)) for m in r.matches)) for r in got), key=str)
    assert have == sorted(((i, *brute(t)) for i, t in rows), key=str)
    by = {r.doc_id: [m.name for m in r.matches] for r in got}
    assert by[50] == ["MIT-line", "MIT-line"] and by[52] == ["MIT"] and by[54] == [] and by[55] == []
    assert licenses.licence_scan(frame(spark).limit(0)).count() == 0


def wrapped(words, width=10):
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))


def brute_runs(text):
    """Best Dice of any run of words, by name."""
    w, best = re.findall("[a-z0-9]+", low(text)), {}
    for name, template in licenses.TEMPLATES + licenses.FURTHER:
        t = re.findall("[a-z0-9]+", low(template))
        b = set(zip(t, t[1:]))
        for i in range(len(w) - 1):
            seen, common = set(), 0
            for g in zip(w[i:], w[i + 1 : i + 1 + (len(t) - 1) * 3 // 2]):
                common += g in b and g not in seen
                seen.add(g)
                if 2 * common / (len(seen) + len(b)) >= licenses.THRESHOLD - 1e-12:
                    best[name] = max(best.get(name, 0), 2 * common / (len(seen) + len(b)))
    return {n: round(d, 9) for n, d in best.items()}


def test_notices_inside_larger_texts(spark):
    own = [f"own{i}" for i in range(400)]
    texts = {n: t for n, t in licenses.TEMPLATES + licenses.FURTHER}
    rows = [(i, wrapped(own[:9] + t.split() + own[9:])) for i, t in enumerate(texts.values())]
    rows.append((90, "A long paragraph of other things that goes on and on, and ends so. Released under the MIT License."))
    rows.append((91, wrapped(own[:50] + texts["MIT"].split() + own[50:90] + texts["ISC"].split() + own[90:200])))
    rows.append((92, wrapped(own[:50] + texts["MIT"].replace("copies of the Software, and", "it and").split() + own[50:400])))
    got = {r.doc_id: r for r in licenses.licence_scan(frame(spark, rows)).collect()}
    for i, text in rows:
        have = {}
        for m in got[i].matches:
            have[m.name] = max(have.get(m.name, 0), round(m.dice, 9))
        want = brute_runs(text)
        assert set(have) == set(want) and want
        in_runs = {m.name for m in got[i].matches if m.unit >= got[i].n_units}
        assert all(have[n] == want[n] for n in in_runs), (i, have, want)
    assert {m.name for m in got[91].matches} == {"MIT", "ISC"} and {m.name for m in got[90].matches} == {"MIT-line"}
