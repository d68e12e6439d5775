"""The exact rules against plain ones, and what the network adds."""

import hashlib
import itertools
import re

import numpy as np

from auditlake.llm import pii


def plain_spans(text):
    """The contract's rules, as plainly as they can be put."""
    digits = lambda t: "".join(c for c in t if c in "0123456789")
    numbers = lambda t: [int(p.lstrip("0")[:4] or 0) for p in t.split(".")]

    def luhn(number):
        twice = [2 * int(d) if i % 2 else int(d) for i, d in enumerate(number[::-1])]
        return sum(n - 9 if n > 9 else n for n in twice) % 10 == 0

    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: max(numbers(t)) <= 255),
        (r"[0-9]([\x20-]?[0-9])+", lambda t: 13 <= len(digits(t)) <= 19 and luhn(digits(t))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(digits(t)) <= 15),
    ]
    return [(k, *m.span()) for k, (rule, good) in enumerate(rules) for m in re.finditer(rule, text) if good(m[0])]


def test_exact_spans_against_plain_rules(spark):
    r = np.random.default_rng(8)
    made = ["".join(r.choice(list(alphabet), int(n))) for alphabet, n in itertools.product(("ab@.-1 +", "0123456789", "0129.", "012 45-", "+12 ().-3", "1.@a+ -٣é"), r.integers(1, 60, 400))]
    for digits in ("4111 1111 1111 1111", "4111-1111-1111-1111", "378282246310005", "6011111111111117x"):
        made += [digits, f"+{digits}", f"a{digits}.1.2", f"{digits} 5"]
    made += ["0" * 5000 + "1.2.3.4", "1.2.3." + "9" * 10_000, "+" + "1" * 10_000, "7" * 10_000 + "@a.b", "1." * 10_000, "@" * 10_000, "0.0.0.000255", "0.0.0.00256"]
    for text in made:
        assert pii.base_spans(text) == plain_spans(text), text[:80]
    assert pii._plausible(1, "0" * 5000 + "1.2.3.4") and not pii._plausible(1, "1.2.3." + "9" * 5000)
    rows = {x.doc_id: x for x in pii.personal_data(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()}
    for i, text in enumerate(made):
        base, row = plain_spans(text), rows[i]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        stated = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert row.base_sha256 == hashlib.sha256(",".join(stated).encode()).hexdigest()
        every = [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in row.spans.split(",") if s)]
        assert every == sorted(every) and set(base) <= set(every)


def test_network_adds_spans(spark):
    text = "words before, call (555) 123-4567 or write, words after " * 3
    row = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_phone == 0 and row.spans.startswith("phone:")
