"""PII: base spans against plain regular expressions, the model's added spans, redaction."""

import re

from tandem.llm import pii

from .edge import ROWS, frame

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE = [
    (40, "a@b.c_x@y.z 1.2.3.4.5.6.7.8 card 4111 1111 1111 1111 and +1 (988) 555-2485 😀 x@y.de"), (41, "9999.1.2.3 256.1.1.1 0001.2.3.4 call (988) 555-2485 now"),
    (42, "mail john (at) example (dot) com or 10[.]0[.]0[.]1 \x01 4111-1111-1111-1111 2024-01-31 12/05/2020"), (43, "a.b.c.d@e.f.g.h " * 400), (44, "5" * 3000 + " " + "a" * 3000 + "@"),
    (45, "x@y" + ".z" * 3000 + " 1" * 3000),
]


def luhn(d):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            fits = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}
            if fits[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_base_spans_match_plain_patterns(spark):
    rows = ROWS + MORE
    got = pii.personal_data(frame(spark, rows)).select("doc_id", pii.listed("base").alias("b"), pii.listed("spans").alias("s")).collect()
    assert sorted(((r.doc_id, r.b) for r in got), key=str) == sorted(((i, brute(t)) for i, t in rows), key=str)
    for r in got:  # base spans stay
        assert set(filter(None, r.b.split(","))) <= set(r.s.split(","))
    by = {r.doc_id: r.s for r in got}
    assert "phone:37:51" in by[41] and "email:5:32" in by[42] and "ip:36:50" in by[42]
    assert all(by[i] == "" for i in (4, 5, 7, 13))
    assert pii.personal_data(frame(spark).limit(0)).count() == 0


def test_held_out_synthetic_precision_and_redaction(spark):
    trained = pii.model(spark)
    assert all(0.0 <= threshold < float("inf") for _, threshold in trained.values())
    out = {r.doc_id: r.redacted for r in pii.redact(frame(spark, MORE[:3] + [(1, None)])).collect()}
    assert out[41] == "9999.1.2.3 256.1.1.1 <ip> call <phone> now" and out[1] == ""


def test_added_spans_do_not_overlap_and_the_text_is_kept(spark):
    rows = MORE + [(50, "call 00 4111 1111 1111 1111 or 10 [.] 0 . 0 . 1 (988) 555-2485/10.0.0.1.22 at 4111.1111.1111.1111 now " * 90), (51, "\x01 mail x@y.de \x01\x02 end")]
    for r in pii.personal_data(frame(spark, rows)).collect():
        base = {(s.start, s.end, s.kind) for s in r.base}
        added = sorted((s.start, s.end) for s in r.spans if (s.start, s.end, s.kind) not in base)
        assert all(a[1] <= b[0] for a, b in zip(added, added[1:]))
        assert all(e <= s or b >= t for b, e in added for s, t, _ in base)
        assert [(s.start, s.rank) for s in r.spans] == sorted((s.start, s.rank) for s in r.spans)
    out = {r.doc_id: r.redacted for r in pii.redact(frame(spark, rows)).collect()}
    assert out[51] == "\x01 mail <email> \x01\x02 end" and "\x01" in out[42]
