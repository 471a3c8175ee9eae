import random

import numpy as np
import pytest

from millrace.llm import fingerprints
from millrace.llm.fingerprints import SPAN, WINDOW, Fingerprint, feature_hashes, likeness

RANKS = fingerprints.ranks_of(np.random.default_rng(1).permutation(fingerprints.LEVELS + 1))
PERIODIC = ["a" * 1000, "=-" * 500, "Der " * 300, "Thsh " * 200, "0123456789abcdef" * 60]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_texts_of_short_periods_differ():
    prints = [Fingerprint(x.encode(), RANKS) for x in PERIODIC]
    assert all(sum(p.sizes) for p in prints)
    assert all(likeness(a, b) < 0.5 for k, a in enumerate(prints) for b in prints[:k])
    for x in PERIODIC:  # three quarters are unchanged
        assert likeness(Fingerprint(x.encode(), RANKS), Fingerprint(fingerprints.edited(x, prose(1, 300)).encode(), RANKS)) > 0.75


@pytest.mark.parametrize("text", [*PERIODIC, prose(2, 300), prose(3, 150) + "Der " * 200 + prose(4, 150), "ab" * 20, prose(5, 8)])
def test_every_run_has_a_feature(text):
    data = np.frombuffer(text.encode(), np.uint8)
    features = set(feature_hashes(data, RANKS).tolist())
    halves = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, WINDOW)).view("<u8")
    own = fingerprints.mixed(fingerprints.mixed(halves[:, 0]) + halves[:, 1]).tolist()
    span = min(SPAN, len(own))
    assert all(features & set(own[k : k + span]) for k in range(len(own) - span + 1))


def test_one_rule_at_all_lengths():
    for seed in range(20):
        text = prose(seed, 100).encode()
        for n in (292, 293, 294, 295):
            own, longer = (set(feature_hashes(np.frombuffer(text[:k], np.uint8), RANKS).tolist()) for k in (n, n + 1))
            # One more byte is one more window: only the last runs may choose anew.
            assert len(own ^ longer) <= 3, (seed, n)
