import hashlib
import random
import re

from plait.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = {k: [] for k in PATTERNS}
    for k, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub(r"\D", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if k == "ip" else True,
                "card": 13 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[k]
            if ok:
                out[k].append(m.span())
    return out


def test_equals_patterns_on_noise():
    rng = random.Random(11)
    for alphabet in ("0123456789. -+()@a", "ab@.-_%+9", "4 -0123456789", "0.1.2 55", "é1.@ a+2-"):
        for _ in range(3000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60)))
            got = pii.find(t)
            assert {k: got[k] for k in pii.BASE} == brute(t), t


def test_planted():
    t = "mail a.b+c@mail7.example.com. card 4111 1111-1111 1111, ip 10.0.0.255 not 1.2.3.256; call +1 (499) 555-6503! see https://x.org/a?b=1). IBAN DE89 3704 0044 0532 0130 00 token = \"04dbebab91ab\""
    f = pii.find(t)
    cut = {k: [t[s:e] for s, e in v] for k, v in f.items()}
    assert cut["email"] == ["a.b+c@mail7.example.com"] and cut["ip"] == ["10.0.0.255"] and cut["phone"] == ["+1 (499) 555-6503"]
    assert cut["card"] == ["4111 1111-1111 1111"] and cut["url"] == ["https://x.org/a?b=1"] and cut["secret"] == ["04dbebab91ab"]
    assert cut["account"] == ["DE89 3704 0044 0532 0130 00"]
    r = pii.redacted(t)
    assert "@" not in r and "4111" not in r and "[EMAIL]" in r and r.endswith('token = "[SECRET]"')


def test_ends_of_accounts():
    cut = lambda t: [t[s:e] for s, e in pii.find(t)["account"]]
    assert cut("IBAN DE89370400440532013000 BIC COBADEFFXXX") == ["DE89370400440532013000"]
    assert cut("pay to GB82 WEST 1234 5698 7654 32, thanks") == ["GB82 WEST 1234 5698 7654 32"]
    assert cut("DE89370400440532013001 xDE89370400440532013000 DE893704004405320130001") == []
    assert cut("account number: 1234-5678 AB12 Tuesday") == ["1234-5678 AB12"] and cut("Account 1234") == []
    assert cut("account 12345678 was closed") == ["12345678"] and cut("accounts 12345678") == []


def test_linear_on_long_runs():
    for t in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "+1" * 100_000, "1-" * 100_000, "@" * 100_000, "account " * 50_000, "account" + " 1A" * 60_000, "DE8" * 70_000, "account: " + "1" * 200_000 + "a"):
        pii.find(t)


def test_rows(spark, edge_docs):
    rows = pii.detect(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    r = [r for r in rows if r.doc_id == 0][0]
    assert (r.n_email, r.spans, r.base_sha256) == (0, "", hashlib.sha256(b"").hexdigest())
    assert pii.detect(edge_docs.limit(0)).count() == 0
    again = pii.redact(edge_docs)
    assert again.columns == edge_docs.columns and again.count() == edge_docs.count()
