import hashlib
import re

from clearcharge.llm.pii import masked, spans_of

KINDS = ("email", "ip", "card", "phone")


def luhn(number):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(number)))) % 10 == 0


def plain(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    found = [(m.start(), KINDS.index(k), m.end(), k) for k, (e, ok) in rules.items() for m in re.finditer(e, text or "") if ok(m.group())]
    return found, ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


CARD = next(str(n) for n in range(4_539_000_000_000_000, 4_539_000_000_000_099) if luhn(str(n)))
TEXTS = [
    None, "", "nothing here", "write a.b+c@mail.example.org, or x@y.z_d@e.f!", "@@a@b a@b.c.d@e.f", "é日 mail: q@r.st 10.0.0.256 10.0.0.255 1.2.3.4.5.6.7.8 00255.1.1.1 1.2.3",
    f"card {CARD} and {CARD[:4]} {CARD[4:8]}-{CARD[8:12]} {CARD[12:]} not {CARD[:-1]}{(int(CARD[-1]) + 1) % 10} {CARD}{CARD}", "call +1 (415) 555-0100. or +12345 +1234567890123456 ++44 20 7946 0958((", "1-2-3 1--2 12 34 56 78 90 12",
    "iban GB82WEST12345698765432 no GB82WEST12345698765433", "ssn 123-45-6789 but 987-65-4321", "a@b.co" * 400, "9" * 5_000, "x" * 20_000 + "@", "a@" + "b." * 9_000 + "c", "+" * 300 + "1 2 3 4 5 6 7 8 9", "1.1.1.1 " * 300,
]


def test_base_spans_are_those_of_the_plain_expressions(spark, documents):
    got = {r.doc_id: r for r in spans_of(documents(TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        found, joined = plain(t)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(f[3] == k for f in found) for k in KINDS], t
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (t, r.spans, joined)
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    assert "iban:5:27" in got[9].spans and got[9].spans.count("iban") == 1
    assert got[10].spans == "ssn:4:15"
    assert got[6].scores.startswith("1.0") and len(got[6].scores.split(",")) == len(got[6].spans.split(","))


def test_masks(spark, documents):
    docs = documents([None, "plain", "to q@r.st and +1 415 555 0100 now", f"{CARD}", "ip 10.0.0.1"])
    out = masked(docs)
    assert out.columns == docs.columns
    assert [r.text for r in out.orderBy("doc_id").collect()] == [None, "plain", "to <EMAIL> and <PHONE> now", "<CARD>", "ip <IP>"]


def test_overlapping_spans_are_masked_once(spark, documents):
    text = "x a@1.2.3.4 y +" + CARD[:4] + " " + CARD[4:] + " z"
    assert masked(documents([text])).first().text.startswith("x <EMAIL> y ")
    assert "1.2.3.4" not in masked(documents([text])).first().text


def test_no_python_in_the_plan(spark, documents):
    plan = spans_of(documents(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
