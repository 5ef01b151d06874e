"""Features of a large batch of images leave in small parts."""

from __future__ import annotations

import numpy as np
import pandas as pd

from recut.sources import frames


def test_features_leave_in_parts():
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 256, (n % 7 + 1) * 48, dtype=np.uint8).tobytes() for n in range(250)]
    batch = pd.DataFrame({"origin": [str(n) for n in range(250)], "height": [n % 7 + 1 for n in range(250)], "width": 16, "nChannels": 3, "data": images})
    parts = list(frames.features_of(iter([batch, batch.iloc[:0], batch.iloc[:3]]), True))
    assert max(len(p) for p in parts) <= frames.FRAMES_AT_ONCE
    whole = pd.concat(parts)
    assert list(whole["origin"]) == [*batch["origin"], "0", "1", "2"]
    assert all(len(d) == 2 * 32 * 32 + 128 for d in whole["descriptor"]) and whole["hist"].map(np.sum).eq([(n % 7 + 1) * 16 for n in [*range(250), 0, 1, 2]]).all()
