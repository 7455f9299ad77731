"""The small labelled table of the PII model: sentences whose words carry a kind or none."""

from __future__ import annotations

import random

KINDS = ["email", "ip", "card", "phone", "secret"]

# {kind} stands for personal data or a secret, {other} for numbers and signs that are neither
SENTENCES = [
    "please write to {email} before noon", "contact: {email} or {phone}", "Reach me at {email}.", "{email}", "mail {email}, thanks",
    "call {phone} after six", "Tel.: {phone}", "phone {phone} or fax {phone}", "our office {phone} is open", "{phone}", "ring {phone}, ask for Anna",
    "the server {ip} is down", "from {ip} to {ip}", "host {ip}, port {other}", "{ip}", "login from {ip} at {other}",
    "paid with {card} today", "card number {card}, valid until {other}", "{card}", "visa {card} was charged {other}",
    "use {secret} to log in", "{secret}", "set {secret} in the config", "key {secret} was leaked on {other}", "then {secret} and more words",
    "the meeting is on {other} in room {other}", "version {other} was released in {other}", "Licensed under CC BY-NC {other}",
    "Apache License, Version {other}", "it costs {other} or {other} more", "chapter {other} of {other} pages", "x = {other}", "a + b = c",
    "in {other} there were {other} people", "see section {other}", "{other}", "{other} {other} {other}", "ISBN {other}", "order {other} shipped",
    "about {other} of all users", "at {other} the train leaves", "1 + {other} = {other}", "GNU General Public License, version {other}",
    "the quick brown fox jumps", "nothing here at all", "ein Satz ohne Zahlen", "une phrase sans rien", "{other}th of May", "page={other}",
]


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _name(rng: random.Random) -> str:
    return "".join(rng.choice("abcdefghijklmnoprstuvz") for _ in range(rng.randint(2, 9)))


def _hex(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789abcdef") for _ in range(n))


def _value(rng: random.Random, kind: str) -> list[tuple[str, bool]]:
    """Words of a value; the second says whether the word is part of it."""
    d = _digits
    if kind == "email":
        return [(f"{_name(rng)}{rng.choice(['', '.' + _name(rng), '.' + d(rng, 2), '_' + d(rng, 1)])}@{_name(rng)}{rng.choice(['', d(rng, 1)])}.{rng.choice(['com', 'example.com', 'org', 'de', 'co.uk'])}", True)]
    if kind == "ip":
        return [(".".join(str(rng.randint(0, 255)) for _ in range(4)) + rng.choice(["", "", ":8080", "/24"]), True)]
    if kind == "card":
        groups = [d(rng, 4) for _ in range(4)]
        return rng.choice([[("".join(groups), True)], [(g, True) for g in groups], [("-".join(groups), True)]])
    if kind == "phone":
        a, b, c = d(rng, 3), d(rng, 3), d(rng, 4)
        return [(w, True) for w in rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+49 {d(rng, 2)} {d(rng, 7)}", f"+33 {d(rng, 1)} {d(rng, 2)} {d(rng, 2)} {d(rng, 2)} {d(rng, 2)}",
                                               f"+44{d(rng, 10)}", f"0{d(rng, 3)}/{d(rng, 7)}", f"+1-{a}-{b}-{c}"]).split()]
    if kind == "secret":
        mixed = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
        key = rng.choice(["password", "token", "secret", "api_key", "passwd"])
        return rng.choice([[(f"{key}={_hex(rng, rng.randint(12, 24))}", True)], [("AKIA" + mixed, True)],
                           [(key, False), ("=", False), (f'"{_hex(rng, rng.randint(24, 40))}"', True)], [(f"{key}:", False), (_hex(rng, 32), True)]])
    return [(rng.choice([
        f"{rng.randint(0, 30)}.{rng.randint(0, 9)}", f"{rng.randint(0, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 20)}", str(rng.randint(1900, 2035)), str(rng.randint(0, 99999)),
        f"{rng.randint(1, 12)}:{d(rng, 2)}", f"{d(rng, 4)}-{d(rng, 2)}-{d(rng, 2)}", f"{d(rng, 2)}.{d(rng, 2)}.{d(rng, 4)}", f"${rng.randint(1, 999)}", f"{rng.randint(1, 99)}%",
        f"{d(rng, 3)},{d(rng, 3)}", f"#{d(rng, 5)}", f"978-{d(rng, 1)}-{d(rng, 2)}-{d(rng, 6)}-{d(rng, 1)}", f"{d(rng, 1)}+{d(rng, 1)}={d(rng, 1)}", f"{_name(rng)}{d(rng, 2)}", f"@{_name(rng)}",
        f"{d(rng, 2)}/{d(rng, 2)}", f"q={_name(rng)}", f"a={d(rng, 1)}", f"No.{d(rng, 2)}", f"{d(rng, 1)}x{d(rng, 1)}", f"C++{d(rng, 2)}", f"{rng.randint(1, 30)}."]), False)]


def labelled_lines(copies: int = 12, seed: int = 5) -> list[list[tuple[str, str]]]:
    """Lines as (word, kind or "") lists, each sentence ``copies`` times with other values; the same at every call."""
    rng = random.Random(seed)
    out = []
    for sentence in SENTENCES * copies:
        line = []
        for part in sentence.split():
            head, brace, rest = part.partition("{")
            kind, _, tail = rest.partition("}")
            if not brace:
                line.append((part, ""))
                continue
            value = _value(rng, kind)
            for i, (w, own) in enumerate(value):
                w = (head if i == 0 else "") + w + (tail if i == len(value) - 1 else "")
                line.append((w, kind if own else ""))
        out.append(line)
    return out
