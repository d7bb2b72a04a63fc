"""Identifiers in random disguises against what was planted, and time on long texts."""

import random
import time

import pytest

from fathomix.llm import pii

WIDE = {c: chr(ord(c) + 0xFEE0) for c in map(chr, range(0x21, 0x7F))}
LOOKS = {"a": "а", "e": "е", "o": "о", "p": "р", "c": "с", "x": "х", "i": "і"}
NAMES = {v: k for k, v in pii.NUMBER_WORDS.items() if k != "oh"}
FILLER = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore magna aliqua enim minim veniam quis nostrud".split()


def luhn_complete(rng, start, length):
    digits = start + "".join(rng.choice("0123456789") for _ in range(length - len(start) - 1))
    for c in "0123456789":
        total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
        if (total + int(c)) % 10 == 0:
            return digits + c


def planted(rng):
    """(source, kind, value) of one identifier in a random disguise; how it is written is independent of the detector."""
    kind = rng.choice(["email", "email", "email", "ssn", "ip", "card", "phone"])
    if kind == "email":
        name = "".join(rng.choice("abcdefghijkmnpqrstuvwxyz") for _ in range(rng.randint(3, 8)))
        if rng.random() < 0.5:
            name += "." + "".join(rng.choice("abcdefgh") for _ in range(3))
        host, end = rng.choice(["example", "mail-host", "corp9"]), rng.choice(["com", "org", "net", "de", "es"])
        value, how = f"{name}@{host}.{end}", rng.randrange(7)
        if how == 0:
            source = value
        elif how == 1:
            left, right = rng.choice(["()", "[]", "{}", "<>"])
            gap = rng.choice(["", " ", "\t"])
            source = value.replace("@", f"{gap}{left}at{right}{gap}").replace(".", f"{gap}{left}DOT{right}{gap}")
        elif how == 2:
            source = value.replace("@", rng.choice([" [at] ", " (AT) "]))
        elif how == 3:
            source = f"{name.replace('.', ' dot ')} at {host} dot {end}"
        elif how == 4:
            source = f"{name} at {host}.{end}"
        elif how == 5:
            source = "".join(WIDE[c] for c in value)
        else:
            source = "".join(LOOKS.get(c, c) for c in name) + "​@" + f"{host}.{end}"
        return source, kind, value
    if kind == "ssn":
        value = f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"
        return rng.choice([value, value.replace("-", "‑"), "".join(WIDE.get(c, c) if c.isdigit() else c for c in value)]), kind, value
    if kind == "ip":
        value = ".".join(str(rng.randint(11, 254)) for _ in range(4))
        return rng.choice([value, value.replace(".", "[dot]")]), kind, value
    if kind == "card":
        value = luhn_complete(rng, "4", 16)
        spaced = " ".join(value[i : i + 4] for i in range(0, 16, 4))
        return rng.choice([value, spaced, " ".join(NAMES[c] for c in value)]), kind, value
    value = "".join(rng.choice("23456789") for _ in range(10))
    shown = f"({value[:3]}) {value[3:6]}-{value[6:]}"
    return rng.choice([shown, " ".join(NAMES[c] for c in value), "tel " + value]), kind, value


@pytest.mark.parametrize("seed", range(3))
def test_mixes_of_all_disguises(spark, seed):
    rng = random.Random(seed)
    rows, want = [], []
    for i in range(400):
        out, at = [], 0
        for _ in range(rng.randint(0, 4)):
            pad = " ".join(rng.choice(FILLER) for _ in range(rng.randint(1, 12))) + rng.choice([": ", ", ", "; "])
            source, kind, value = planted(rng)
            begin = at + len(pad) + (4 if source.startswith("tel ") else 0)
            out += [pad, source]
            at += len(pad) + len(source)
            want.append((i, begin, at - begin, kind, value))
            out.append(end := rng.choice([", ", "; ", " | "]))
            at += len(end)
        out.append(" ".join(rng.choice(FILLER) for _ in range(rng.randint(1, 30))))
        rows.append((i, "".join(out)))
    got = [(r.doc_id, r.start, r.length, r.kind, r.value) for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(want)


def test_bare_figures_need_a_word():
    assert [x[2:] for x in pii.identifiers("please call me on 5552345678 now")] == [("phone", "5552345678")]
    assert pii.identifiers("record 5552345678 of the list") == [] and pii.identifiers("call 1234567890") == []
    assert [x[3] for x in pii.identifiers("jane at mail dot nl")] == ["jane@mail.nl"]


LONG = {
    "runs of dotted letters": "a." * 500_000 + " x at y",
    "blanks": "(" + " " * 1_000_000 + "at",
    "hosts": "x at " + "a." * 500_000,
    "hyphens": "x@" + "a-" * 500_000,
    "spelled": "a dot " * 150_000 + "at",
    "pivots": "a at " * 200_000,
    "figures": "1 " * 500_000,
    "brackets": "( " * 400_000,
    "names": "one-" * 250_000,
}


@pytest.mark.parametrize("name", LONG)
def test_long_texts_take_time_in_proportion(name):
    began = time.process_time()
    pii.identifiers(LONG[name])
    assert time.process_time() - began < 5


def test_many_addresses_in_one_text(spark):
    began = time.process_time()
    text = " ".join(f"user{i}@example.com" for i in range(100_000))
    found = pii.identifiers(text)
    assert len(found) == 100_000 and time.process_time() - began < 5
    assert pii.scan(spark.createDataFrame([(1, text), (2, "a." * 500_000 + " at ")], "doc_id long, text string")).count() == 100_000
