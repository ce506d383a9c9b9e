"""How many planted random strings the token-efficiency test finds, and how many harmless runs it takes for one."""

import base64
import hashlib
import random
import string
import uuid

import pytest

from strandset.llm import secrets

ALPHABETS = {
    "letters and digits": string.ascii_letters + string.digits,
    "lower and digits": string.ascii_lowercase + string.digits,
    "base64": string.ascii_letters + string.digits + "+/",
    "url-safe": string.ascii_letters + string.digits + "-_",
}
WORDS = "the committee reviewed annual report international understanding organization environment configuration production document service".split()


def texts(seed, n):
    """(kind, planted string, text) with the string between words."""
    r = random.Random(seed)

    def prose(k):
        return " ".join(r.choice(WORDS) for _ in range(k))

    out = []
    for _ in range(n):
        for name, letters in ALPHABETS.items():
            for size in (20, 24, 32, 48):
                out.append((f"{name} {size}", "".join(r.choice(letters) for _ in range(size))))
        out.append(("sha256", hashlib.sha256(r.randbytes(8)).hexdigest()))
        out.append(("md5", hashlib.md5(r.randbytes(8)).hexdigest()))
        out.append(("uuid", str(uuid.UUID(bytes=r.randbytes(16)))))
        out.append(("path", "/".join(r.choice(WORDS) for _ in range(5))))
        out.append(("snake", "_".join(r.choice(WORDS) for _ in range(4))))
        out.append(("camel", "".join(r.choice(WORDS).title() for _ in range(4))))
        out.append(("base64 of prose", base64.b64encode(prose(4).encode()).decode().rstrip("=")))
    return [(kind, s, f"{prose(5)} {s} {prose(5)}") for kind, s in out]


@pytest.fixture(scope="module")
def rates(spark):
    planted = texts(17, 60)
    found = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(planted)], "doc_id long, text string")).collect()}
    hits: dict[str, list[bool]] = {}
    for i, (kind, s, text) in enumerate(planted):
        at = text.index(s)
        hits.setdefault(kind, []).append(any(x["kind"] == "opaque" and x["start"] < at + len(s) and x["end"] > at for x in found[i]))
    return {kind: sum(h) / len(h) for kind, h in hits.items()}


def test_random_strings_are_found(rates):
    print(rates)
    random_ = {k: v for k, v in rates.items() if k.rsplit(" ", 1)[0] in ALPHABETS}
    assert sum(random_.values()) / len(random_) > 0.9 and min(v for k, v in random_.items() if not k.endswith("20")) > 0.8


def test_digests_identifiers_and_words_are_not(rates):
    assert [rates[k] for k in ("sha256", "md5", "uuid", "path", "snake", "camel")] == [0] * 6
