"""The field on generated lines it has not seen."""

from __future__ import annotations

import random

import pytest

from veilframe.llm import secrets


def test_held_out_lines():
    right = secret = good = found = 0
    field = secrets.trained()
    for tokens, tags in secrets._made(random.Random(991)):
        text, at, gold = " ".join(tokens), 0, []
        for token, tag in zip(tokens, tags):
            if tag != secrets.O:
                gold.append((at, at + len(token)))
            at += len(token) + 1
        spans = [(s, e) for s, _, e in secrets.secret_spans(text, field)[1]]
        meets = lambda x, some: any(x[0] < e and s < x[1] for s, e in some)
        right, secret = right + sum(meets(x, spans) for x in gold), secret + len(gold)
        good, found = good + sum(meets(x, gold) for x in spans), found + len(spans)
    print(f"recall {right / secret:.3f} of {secret}, precision {good / found:.3f} of {found}")
    assert right >= 0.9 * secret and good >= 0.9 * found


@pytest.mark.parametrize("text", ["request 3f2b8c1e-9d4a-4f7b-8a1c-2e5d6f7a8b9c done", "see commit 3f2b8c1e9d in the log", "your order A1B2C3D4E5 has left the house"])
def test_plain_ids_stay(text):
    assert secrets.secret_spans(text, secrets.trained())[1] == []
