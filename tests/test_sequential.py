import random

from tessera.operators.sequential import Candidate, anchor_number, diversified, repaired


def brute_force(candidates, limit, intent):
    chosen = []
    while len(chosen) < limit:
        best = None
        for i, c in enumerate(candidates):
            if i in [k for k, _ in chosen]:
                continue
            others = [candidates[k] for k, _ in chosen]
            own = [o for o in others if o.document == c.document]
            if intent == "citation" and (len(own) >= 1 or any(abs(int(o.anchor[3:]) - int(c.anchor[3:])) <= 1 for o in own)):
                continue
            alike = sum(o.kind == c.kind for o in others)
            value = c.score + 0.45 * (not own) + 0.2 * (alike == 0) - 0.65 * len(own)
            value -= 0.85 * sum(o.section == c.section for o in own) + 0.75 * sum(o.anchor == c.anchor for o in own) + 0.5 * any(abs(o.place - c.place) <= 1 for o in own)
            if not (intent == "findings" and c.kind == "findings"):
                value -= 0.35 * max(0, alike - 1)
            key = (-round(value, 4), c.document, c.place)
            if best is None or key < best[0]:
                best = (key, i)
        if best is None:
            break
        chosen.append((best[1], -best[0][0]))
    return chosen


def test_diversified():
    rng = random.Random(3)
    for k in range(60):
        page = {}
        for _ in range(rng.randint(0, 25)):
            place = rng.randint(0, 9)
            c = Candidate(rng.randint(1, 5), rng.choice("ab"), f"x-p{place // 2}", place, rng.choice(("findings", "y", "z")), rng.randint(0, 40) / 20)
            page[c.document, c.place] = c
        page = list(page.values())
        intent = ("", "citation", "findings")[k % 3]
        assert diversified(page, 8, intent) == brute_force(page, 8, intent)


def test_anchor_numbers():
    assert [anchor_number(x) for x in ("body-p12", "p3", "a#P7", "top", "", "xp4")] == [12, 3, 7, None, None, None]


def test_repaired():
    assert repaired([]) == []
    assert repaired([(50, "general_body", 0.0)]) == [(0, 1, "none")]
    body = (300, "general_body", 0.0)
    assert repaired([body, (20, "heading", 0.0), body]) == [(0, 1, "none"), (1, 3, "heading")]
    assert repaired([body] * 4) == [(0, 3, "none"), (3, 4, "none")]
    assert repaired([body, (200, "holding_disposition", 0.0)]) == [(0, 1, "none"), (1, 2, "disposition_tail")]
    assert repaired([(200, "general_body", 3.0), (200, "general_body", 0.5)]) == [(0, 1, "none"), (1, 2, "density_shift")]
    assert repaired([(200, "findings", 1.0), (200, "facts_background", 1.0)]) == [(0, 1, "none"), (1, 2, "kind_shift")]
