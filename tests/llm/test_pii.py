import hashlib
import math
import re
import time
from collections import Counter

from graftline.llm import pii

SCHEMA = "doc_id long, text string, kind string, spans int, base string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": all(int(p) <= 255 for p in v.split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def base(text):
    return sorted((m.start(), n, m.end(), m.group()) for n, k in enumerate(PLAIN) for m in re.finditer(PLAIN[k], text or "") if valid(k, m.group()))


TERM = re.compile(r"(?<=[ \t\n\r\f\v])[^\W\d_]{3,}(?=[.,;:!?]*[ \t\n\r\f\v])")


def brute(rows, support=5, threshold=0.95):
    all_terms = Counter(w.lower() for _, t in rows for w in TERM.findall(t or ""))
    every = sum(all_terms.values())
    ents, joint, beside = Counter(), Counter(), []
    for i, (_, t) in enumerate(rows):
        for s, k, e, v in base(t):
            ent = (k, v.lower())
            ents[ent] += 1
            for off, part in ((max(0, s - 80), t[max(0, s - 80) : s]), (e, t[e : e + 80])):
                for m in TERM.finditer(part):
                    joint[ent, m.group().lower()] += 1
                    beside.append((i, ent, m.group().lower(), off + m.start(), off + m.end()))
    out = [set() for _ in rows]
    for i, ent, w, a, b in beside:
        n = joint[ent, w]
        if n >= support and 1 - math.log2(min(1, n / all_terms[w])) / math.log2(ents[ent] / every) >= threshold:
            out[i].add((a, 4, b))
    names = [*PLAIN, "term"]
    shown = lambda spans: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return [(i, shown({x[:3] for x in base(t)}), shown({x[:3] for x in base(t)} | o)) for (i, t), o in zip(rows, out)]


ROWS = (
    [(i, f"Please ask Gudrun about it, mail jo.x+y@mail{i // 28}.example.com or the office today {i}.") for i in range(30)]
    + [(100 + i, "the office about mail today, please ask the others or what about it.") for i in range(40)]
    + [(200, "1.2.3.4.5 and 1.2.x.3.4.5.6 or 256.1.1.1 at 010.000255.1.1 é ü 9.9.9.9"), (201, "4111 1111 1111 1111 x 4111-1111-1111-1112 y 4111111111111111 1"), (202, "+49 (30) 123.456-78 ( +1 22 +123456789012345678 +1234567890"), (203, "a@b@c.de a@b.c%x@d.e ...@-.-.- x@y"), (204, None), (204, ""), (None, "9.8.7.6"), (None, "9.8.7.6"), (205, "1" * 3000 + "." * 9 + "a" * 3000 + " \U0001f600 a@b.cc"), (206, "a@b" + ".c" * 20000), (207, "\U0001f600\U0001f600 p@q.rs 1 " * 40), (208, "+1 22 33 " + " " * 30000 + "x")]
)


def test_spans_match_brute_force(spark):
    got = [(str(r.doc_id), r.base_sha256, r.spans) for r in pii.report(spark.createDataFrame([(i, t, "", 0, "") for i, t in ROWS], SCHEMA)).collect()]
    want = [(str(i), hashlib.sha256(b.encode()).hexdigest(), s) for i, b, s in brute(ROWS)]
    assert sorted(got) == sorted(want)
    assert any("term" in s for *_, s in want)


def test_sanitised_text(spark):
    got = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame([(i, t, "", 0, "") for i, t in ROWS if i is not None], SCHEMA)).collect()}
    assert "Gudrun" not in got[0] and "[EMAIL]" in got[0] and "@" not in got[0]
    assert got[100] == "the office about mail today, please ask the others or what about it."
    assert got[204] == ""


def test_counts_and_no_rows(spark):
    r = pii.report(spark.createDataFrame([(1, "a@b.cc 1.1.1.1 1.1.1.1 +12 345 678 901", "", 0, "")], SCHEMA)).collect()[0]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 2, 0, 1)
    assert pii.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_addresses_with_parts_of_zero(spark):
    good = ["10.0.0.1", "192.168.0.1", "127.0.0.1", "0.0.0.0", "000.0.00.1", "8.8.8.0"]
    rows = [(i, f"host {a} is up") for i, a in enumerate([*good, "0.256.0.1", "0.0.0.0256"])]
    df = spark.createDataFrame([(i, t, "", 0, "") for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in pii.report(df).collect()}
    assert [got[i].n_ip for i in range(len(rows))] == [1] * len(good) + [0, 0]
    assert sorted((str(r.doc_id), r.base_sha256, r.spans) for r in got.values()) == [(str(i), hashlib.sha256(b.encode()).hexdigest(), s) for i, b, s in brute(rows)]
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all(clean[i] == "host [IP] is up" for i in range(len(good)))


WORD = re.compile(r"[^\W\d_]{3,}")


def brute_words(rows, support=5, threshold=0.95):
    """Terms of each row: whole words outside addresses, within 80 code points of an entity."""
    masked = [re.sub(PLAIN["email"], lambda m: " " * len(m.group()), t) for _, t in rows]
    words = [[(m.start(), m.end(), m.group().lower()) for m in WORD.finditer(t)] for t in masked]
    n_term = Counter(w for row in words for *_, w in row)
    every, ents, joint, beside = sum(n_term.values()), Counter(), Counter(), []
    for i, (_, t) in enumerate(rows):
        for s, k, e, v in base(t):
            ents[k, v.lower()] += 1
            for a, b, w in words[i]:
                if s - 80 <= a and b <= s or e <= a and b <= e + 80:
                    joint[k, v.lower(), w] += 1
                    beside.append((i, (k, v.lower()), a, b, w))
    out = [set() for _ in rows]
    for i, ent, a, b, w in beside:
        n = joint[(*ent, w)]
        if n >= support and 1 - math.log2(min(1, n / n_term[w])) / math.log2(ents[ent] / every) >= threshold:
            out[i].add(f"term:{a}:{b}")
    return out


def test_terms_beside_punctuation_and_at_the_ends(spark):
    mail = "gudrun.meyer@x.example"
    shapes = [f'"Gudrun Meyer" <{mail}>', f"(Gudrun) {mail}", f"contact:Gudrun/{mail}", f"Gudrun {mail}", f"{mail} Gudrun", f"Anne-Marie's {mail}, +49 (30) 123.456-78", f"Anne-Marie {mail}!"]
    rows = [(i, shapes[i % 7]) for i in range(42)] + [(100 + i, "the office about mail today, please ask the others or what about it. " * 9) for i in range(40)]
    rows += [(200 + n, "é " + "Ottokar " + "- " * 30 + "-" * n + f" Zed{'a' * n} {mail} " + "-" * (70 + n) + " Ottokar") for n in range(16)]
    rows += [(300 + n, "Kél" + f"{mail} Werner") for n in range(8)]
    df = spark.createDataFrame([(i, t, "", 0, "") for i, t in rows], SCHEMA)
    got = {r.doc_id: {s for s in r.spans.split(",") if s.startswith("term")} for r in pii.report(df).collect()}
    assert got == {i: w for (i, _), w in zip(rows, brute_words(rows), strict=True)}
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert [clean[i] for i in (*range(42), 300) if any(w in clean[i] for w in ("Gudrun", "Meyer", "Anne", "Marie", "Werner", "@"))] == []


def cleaned(text, spans):
    """The plain replacement: first spans win, kinds get their name, terms go."""
    out, at = "", 0
    for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans.split(",") if x)), key=lambda x: (x[1], [*PLAIN, "term"].index(x[0]), x[2])):
        if a >= at:
            out, at = out + text[at:a] + ("" if kind == "term" else f"[{kind.upper()}]"), b
    return out + text[at:]


def test_report_has_the_sanitised_text(spark):
    df = spark.createDataFrame([(i, t, "", 0, "") for i, t in ROWS if i is not None], SCHEMA)
    texts, n = dict(pair for pair in ROWS if pair[0] is not None), 0
    for r in pii.report(df).collect():
        assert r.n_term == r.n_general + r.n_removed
        if not r.n_general and texts[r.doc_id]:
            n += 1
            assert r.clean_sha256 == hashlib.sha256(cleaned(texts[r.doc_id], r.spans).encode()).hexdigest(), r.doc_id
    assert n > 60


def test_a_long_text_with_many_matches_takes_seconds(spark):
    text = " ".join(f"n{i}@ex.am, jo" for i in range(50_000))
    df = spark.createDataFrame([(1, text, "", 0, "")], SCHEMA)
    began = time.perf_counter()
    r = pii.report(df).collect()[0]
    assert r.n_email == 50_000 and r.base_sha256 == hashlib.sha256(",".join(f"email:{a}:{b}" for a, _, b, _ in base(text)).encode()).hexdigest()
    assert time.perf_counter() - began < 60
