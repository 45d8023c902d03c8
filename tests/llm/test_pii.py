"""Pseudonyms keep format and links, and are permutations."""

import hashlib
from collections import Counter

import pytest

from tessera.llm import catalog, pii

F = pii.Feistel(b"test")


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1000])
def test_every_domain_is_permuted(n):
    assert sorted(F.below("k", n, i) for i in range(n)) == list(range(n))


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("card 4111 1111 1111 1111.", ["card"]),
        ("two 7536784127813050 4845168114407329 in a row", ["card", "card"]),
        ("call +1 (826) 555-4081 or (212) 555-0100", ["phone", "phone"]),
        ("born 1984-02-29, seen 31/12/1999", ["date", "date"]),
        ("no date 1983-02-29 nor 32/12/1999", []),
        ("ssn 123-45-6789 not 000-45-6789", ["ssn"]),
        ("ip 190.137.223.204### not 300.1.1.1 nor version 3.0", ["ipv4"]),
        ("GB82 WEST 1234 5698 7654 32 but GB82 WEST 1234 5698 7654 33", ["iban"]),
        ("was.91@mail6.example.com", ["email"]),
        ('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"###', ["secret"]),
        ("Licensed under CC BY-NC 4.0 in 2024, page 12-14", []),
    ],
)
def test_kinds(text, kinds):
    new, found = pii.pseudonymise(text, F)
    assert [k for _, _, k, _ in found] == kinds
    assert (new == text) == (not kinds)
    again, back = pii.pseudonymise(new, F)
    assert [k for _, _, k, _ in back] == kinds, "a pseudonym is a valid value of its kind"
    for a, b, kind, value in found:
        assert value != text[a:b] and (kind == "ipv4" or len(value) == b - a)


def test_equal_values_stay_linked_and_validity_is_kept():
    a = pii.card(F, "4111111111111111")
    assert pii.card(F, "4111-1111-1111-1111").replace("-", "") == a
    assert str(pii.luhn_digit(a[:-1])) == a[-1]
    seen = Counter(pii.card(F, str(10**15 + i)) for i in range(3000))
    assert max(seen.values()) == 1
    assert len({pii.email(F, f"ab.{i:02d}@h.org") for i in range(100)} | {pii.email(F, f"{x}b.11@h.org") for x in pii.LOWER if x != "a"}) == 125


def plain_below(key, kind, n, value, back):
    """The permutation as its description says, or its inverse."""
    b = max(2, int(n**0.5) + 1)
    a = -(-n // b)

    def draw(r, x):
        return int.from_bytes(hashlib.blake2b(f"{kind}|{n}|{r}|{x}".encode(), key=key, digest_size=16).digest(), "big")

    while True:
        left, right = value // b, value % b
        for r in [6, 4, 2, 0] if back else [0, 2, 4, 6]:
            if back:
                right = (right - draw(r + 1, left)) % b
                left = (left - draw(r, right)) % a
            else:
                left = (left + draw(r, right)) % a
                right = (right + draw(r + 1, left)) % b
        value = left * b + right
        if value < n:
            return value


@pytest.mark.parametrize("n", [2, 31, 1000, 10**9, 1 << 32])
def test_permutations_can_be_undone(n):
    for value in {0, 1, n // 3, n - 1}:
        new = plain_below(b"test", "k", n, value, False)
        assert F.below("k", n, value) == new and plain_below(b"test", "k", n, new, True) == value


def restored(key, kind, new):
    """What a pseudonym stood for, by the inverse permutations and nothing of the operator's."""
    digits = "".join(ch for ch in new if ch in "0123456789")
    number = lambda kind, s: str(plain_below(key, kind, 10 ** len(s), int(s), True)).zfill(len(s))

    def filled(shape, chars):
        it = iter(chars)
        return "".join(next(it) if ch.isalnum() else ch for ch in shape)

    def check(body):
        total = sum(sum(divmod(int(ch) * (2 if i % 2 == 0 else 1), 10)) for i, ch in enumerate(reversed(body)))
        return -total % 10

    if kind == "card":
        body = number("card", digits[:-1])
        return filled(new, body + str((int(digits[-1]) - check(digits[:-1]) + check(body)) % 10))
    if kind == "ipv4":
        value = plain_below(key, "ipv4", 1 << 32, sum(int(p) << 8 * (3 - i) for i, p in enumerate(new.split("."))), True)
        return ".".join(str(value >> 8 * (3 - i) & 255) for i in range(4))
    if kind == "ssn":
        fine = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        d = number("ssn", digits)
        while not fine(d):
            d = number("ssn", d)
        return filled(new, d)
    if kind == "secret":
        value = plain_below(key, "hex", 16 ** len(new), int(new, 16), True)
        out = format(value, "x").zfill(len(new))
        return out.upper() if new.isupper() else out
    return None


def test_pseudonyms_lead_back_to_the_text(spark, sf):
    """Kinds whose inverse is written out above, over all documents: what stands in the text comes back."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = Counter()
    for r in pii.replace_personal(spark.read.parquet(f"{sf}/documents.parquet"), b"other").collect():
        text, at, out = docs[r.doc_id], 0, []
        for x in r.found:
            out += [text[at : x.start], x.pseudonym]
            at = x.end
            back = restored(b"other", x.kind, x.pseudonym)
            if back is not None:
                assert back == text[x.start : x.end]
                seen[x.kind] += 1
        assert r.text == "".join(out) + text[at:]
    assert len(seen) >= 2, seen


def test_many_finds_take_linear_time():
    import time

    took = []
    for n in (2000, 16000):
        text = "a@b.co 190.137.223.204 " * n
        began = time.perf_counter()
        assert len(pii.pseudonymise(text, F)[1]) == 2 * n
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0]


def test_query_and_odd_rows(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = catalog.op5_pseudonyms(spark, sf).collect()
    f = pii.Feistel(catalog.PII_KEY)
    assert {r.doc_id: r.text for r in out} == {k: pii.pseudonymise(v, f)[0] for k, v in docs.items()}
    assert 0 < sum(r.n_found > 0 for r in out) < len(out)
    rows = [(1, None, "x"), (None, "", "y"), (2, "a@b.co " * 5000, None), (2, "a@b.co " * 5000, None)]
    odd = pii.replace_personal(spark.createDataFrame(rows, "doc_id long, text string, found string"), b"k").collect()
    assert sorted(r.n_found for r in odd) == [0, 0, 5000, 5000] and {r.text for r in odd if r.doc_id == 1} == {None}
    assert pii.replace_personal(spark.createDataFrame([], "doc_id long, text string"), b"k").count() == 0
