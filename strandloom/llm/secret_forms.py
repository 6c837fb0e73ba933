"""Drawn secrets of many forms, and look-alikes that are none, to train the field of the secret scan.

A form is drawn from a seeded generator: the value, the name or cue that announces it, and what
separates them. Look-alikes are addresses, paths, versions, dates, identifiers and cues with plain
words. The forms follow no issuer's format: prefixes, lengths and alphabets are drawn.
"""

from __future__ import annotations

import random
import re

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
NAMES = (
    "pwd passphrase pass key apikey access_key client_secret auth_token credential credentials private_key DB_PASSWORD api-key "
    "passcode authToken SECRET_KEY accessToken Authorization login_pass signing_key"
).split()
SEPARATORS = (" : ", ": ", " = ", "=", ":", '="', ' = "')
#: Words between drawn forms, in texts of few and of many.
EVERY = (5, 30, 60, 100)
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def _of(r: random.Random, alphabet: str, least: int, most: int) -> str:
    return "".join(r.choices(alphabet, k=r.randint(least, most)))


def _syllables(r: random.Random, least: int, most: int) -> str:
    return "".join(r.choice("bcdfghlmnprstvw") + r.choice("aeiou") + r.choice(("", "", "n", "r", "s", "st", "th")) for _ in range(r.randint(least, most)))


def _prefixed(r: random.Random) -> str:
    joint = r.choice("_-")
    return joint.join([*(_of(r, LOWER, 2, 6) for _ in range(r.randint(1, 2))), _of(r, LOWER + UPPER + DIGITS, 16, 48)])


def _groups(r: random.Random) -> str:
    letters = r.choice((UPPER + DIGITS, LOWER + UPPER + DIGITS))
    parts = [_of(r, r.choice((letters, letters, DIGITS)), 5, 14) for _ in range(r.randint(2, 4))]
    return "-".join([*(_of(r, LOWER, 2, 6) for _ in range(r.randint(0, 1))), *parts, _of(r, letters, 8, 32)])


#: Families of values that are secret by themselves; a family that stands twice is drawn twice as often.
BARE = (
    ("mixed", lambda r: _of(r, LOWER + UPPER + DIGITS, 20, 64)),
    ("base64", lambda r: _of(r, LOWER + UPPER + DIGITS + "+/", 24, 88) + "=" * r.randint(0, 2)),
    ("url_safe", lambda r: _of(r, LOWER + UPPER + DIGITS + "_-", 24, 64)),
    ("hex_capitals", lambda r: _of(r, UPPER[:6] + DIGITS, 24, 64)),
    ("small_digits", lambda r: _of(r, LOWER + DIGITS, 24, 48)),
    ("capitals_digits", lambda r: _of(r, UPPER + DIGITS, 20, 40)),
    ("prefixed", _prefixed),
    ("prefixed", _prefixed),
    ("dotted", lambda r: ".".join(_of(r, LOWER + UPPER + DIGITS + "_-", 10, 60) for _ in range(3))),
    ("groups", _groups),
    ("groups", _groups),
    ("address", lambda r: f"{r.choice(('postgres', 'mysql', 'amqp', 'https'))}://{_syllables(r, 1, 3)}:{_of(r, LOWER + UPPER + DIGITS, 8, 20)}@{_syllables(r, 2, 3)}.{r.choice(('com', 'net', 'local'))}"),
    ("lines", lambda r: "\n".join(_of(r, LOWER + UPPER + DIGITS + "+/", 48, 64) for _ in range(r.randint(2, 10)))),
)
#: Families of values that only a cue makes secret.
CUED = (
    ("signs", lambda r: _of(r, LOWER + UPPER + DIGITS + "!#$%&*@^+?", 8, 24)),
    ("small", lambda r: _of(r, LOWER, 12, 24)),
    ("capitals", lambda r: _of(r, UPPER, 12, 24)),
    ("syllables", lambda r: _syllables(r, 5, 9)),
    ("letters", lambda r: _of(r, LOWER + UPPER, 10, 24)),
    ("short_digits", lambda r: _of(r, LOWER + DIGITS, 8, 20)),
    ("syllables_digits", lambda r: _syllables(r, 2, 4) + _of(r, DIGITS, 2, 4) + r.choice(("", "!", "#"))),
)
#: Look-alikes.
PLAIN = (
    lambda r: f"{_syllables(r, 1, 3)}.{_syllables(r, 1, 3)}{r.randint(1, 99)}@{_syllables(r, 2, 4)}.{r.choice(('com', 'org', 'net'))}",
    lambda r: f"https://www.{_syllables(r, 2, 4)}.com/{_syllables(r, 2, 4)}/{_syllables(r, 2, 4)}-{_syllables(r, 2, 3)}?id={r.randint(1, 99999)}",
    lambda r: "/" + "/".join(_syllables(r, 1, 3) for _ in range(r.randint(3, 6))) + r.choice((".txt", ".py", "", ".tar.gz")),
    lambda r: f"{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 20)}{r.choice(('', '-beta', '-rc1', '.dev4'))}",
    lambda r: f"{r.randint(1950, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}",
    lambda r: ".".join(str(r.randint(1, 254)) for _ in range(4)),
    lambda r: f"+{r.randint(1, 99)} {r.randint(100, 999)} {r.randint(1000, 9999)} {r.randint(1000, 9999)}",
    lambda r: f"${r.randint(1, 999)},{r.randint(100, 999)},{r.randint(100, 999)}.{r.randint(10, 99)}",
    lambda r: _syllables(r, 1, 2) + "".join(_syllables(r, 1, 3).capitalize() for _ in range(r.randint(2, 4))),
    lambda r: "_".join(_syllables(r, 1, 3) for _ in range(r.randint(3, 6))),
    lambda r: "-".join(_syllables(r, 1, 3) for _ in range(r.randint(2, 5))),
    lambda r: _syllables(r, 6, 10),
    lambda r: _syllables(r, 3, 8).upper(),
    lambda r: f"978-{r.randint(0, 9)}-{r.randint(10, 99)}-{r.randint(100000, 999999)}-{r.randint(0, 9)}",
    lambda r: f"{_syllables(r, 2, 3)}_{r.randint(1990, 2030)}_{_syllables(r, 1, 2)}_v{r.randint(1, 12)}.pdf",
    lambda r: r.choice("a=-*x0#") * r.randint(8, 60),
    lambda r: f"<a href=\"{_syllables(r, 2, 3)}.html\" class=\"{_syllables(r, 1, 3)}\">",
    lambda r: f"{_syllables(r, 1, 3)}({_syllables(r, 1, 2)}[{r.randint(0, 99)}],{_syllables(r, 1, 2)}={r.randint(0, 999)})",
    lambda r: f"{r.choice(NAMES)}{r.choice((' : ', ': ', ' = ', ' '))}{_syllables(r, 1, 3)}",
    lambda r: f"the {r.choice(('key', 'token', 'secret', 'password', 'pass'))} {_syllables(r, 1, 3)} {_syllables(r, 1, 3)}",
    lambda r: f"{_syllables(r, 1, 3)}{r.choice((': ', ' = ', ' : '))}{_syllables(r, 2, 4)}",
    lambda r: f"{_syllables(r, 1, 2)}{r.randint(100, 9999999)}",
    lambda r: f"{_syllables(r, 1, 2)}{r.choice((' is ', ' ', '. '))}{_syllables(r, 5, 9)}{r.choice(('', '.', ',', '!!'))}",
    lambda r: " ".join([_of(r, LOWER, 2, 6)] * r.randint(3, 12)),
    lambda r: f"Author: {_syllables(r, 1, 3).capitalize()} {_syllables(r, 2, 3).capitalize()}",
)


def draw(r: random.Random, without: frozenset[str] = frozenset()) -> tuple[str, int, int]:
    """A form and the part of it that is secret (empty for a look-alike); no value is of a family in ``without``."""
    if r.random() < 0.5:
        form = r.choice(PLAIN)(r)
        return form, 0, 0
    cued = r.random() < 0.5
    value = r.choice([f for name, f in (CUED if cued else BARE) if name not in without])(r)
    lead, tail = "", r.choice(("", "", "", ",", ".", ";"))
    if cued or r.random() < 0.5:
        separator = r.choice(SEPARATORS)
        lead = r.choice(NAMES) + separator
        if not cued and r.random() < 0.3:
            lead = r.choice(("Bearer ", "Authorization: Bearer ", "the key is ", "auth ", "key "))
        tail = '"' if '"' in separator and lead.endswith('"') else tail
    return lead + value + tail, len(lead), len(lead) + len(value)


def sprinkle(text: str, r: random.Random, without: frozenset[str] = frozenset()) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]]:
    """The text with drawn forms between its words; the byte spans of the secrets, and of all forms."""
    raw = text.encode()
    gaps = [m.start() for m in _SPACE.finditer(raw)]
    if not raw.strip():
        return text, [], []
    places = sorted(r.choices([*gaps, len(raw)], k=max(2, len(gaps) // r.choice(EVERY))))
    out, secret, all_forms, at = bytearray(), [], [], 0
    for place in places:
        out += raw[at:place] + b" "
        at = place
        form, a, b = draw(r, without)
        if b:
            secret.append((len(out) + a, len(out) + b))
        all_forms.append((len(out), len(out) + len(form)))
        out += form.encode() + b" "
    return (out + raw[at:]).decode(), secret, all_forms
