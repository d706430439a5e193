"""Samples that arrive out of order, over many batches, are counted as one pass in order of time would."""

import random

from spanloom.streaming import streams as T
from tests.test_streaming import S, arrivals

KIND = "device string, id long, at_us long, state string"


def test_identity_samples_over_batches(spark, tmp_path):
    r = random.Random(5)
    rows = [(r.choice("ppq"), i, r.randint(1, 3000) * S, r.choice(["active", "unattributed", "idle"])) for i in range(150)]
    arrivals(spark, str(tmp_path / "in"), rows, KIND, 2, 60 * S, 4, 5)
    src = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restart adds nothing
        T.identity_samples(src, str(tmp_path / "out"), str(tmp_path / "cp"), recent=7, delay="1 minute")
    got = spark.read.schema("device string, id long, windows long, untitled long").parquet(str(tmp_path / "out/*")).collect()
    want, seen = [], {}
    for device, i, _, state in sorted(rows, key=lambda x: (x[0], x[2], x[1])):
        last = seen[device] = (seen.get(device, []) + [state])[-7:]
        want.append((device, i, len(last) - last.count("idle"), last.count("unattributed")))
    assert sorted(tuple(x) for x in got) == sorted(want)
    assert len({f.name for f in (tmp_path / "out").iterdir()}) > 2
