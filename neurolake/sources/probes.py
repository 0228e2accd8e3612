"""Layouts of the two 32-contact probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Which recording channel each contact is wired to; per column of contacts x, first height, step and number.
WIRING = [30, 26, 21, 17, 27, 22, 20, 25, 28, 23, 19, 24, 29, 18, 31, 16, 0, 15, 2, 13, 8, 9, 7, 1, 6, 14, 10, 11, 5, 12, 4, 3]
RUNS = {
    "poly2": [(-21.65, 300.0, 50.0, 10), (-21.65, 250.0, -50.0, 6), (21.65, 25.0, 50.0, 6), (21.65, 775.0, -50.0, 10)],
    "poly3": [(-18.0, 12.5, 25.0, 10), (0.0, 0.0, 50.0, 6), (0.0, 275.0, -50.0, 6), (18.0, 237.5, -25.0, 10)],
}
RADIUS = 7.5


def probe_contacts(spark: SparkSession, probe: str) -> DataFrame:
    """``probe, contact, x_um, y_um, radius_um, device_channel``; the name's case doesn't matter."""
    name = probe.lower()
    if name not in RUNS:
        raise ValueError(f"no probe {probe}")
    places = [(x, y + k * step) for x, y, step, n in RUNS[name] for k in range(n)]
    rows = [(name, i, x, y, RADIUS, WIRING[i]) for i, (x, y) in enumerate(places)]
    return spark.createDataFrame(rows, "probe string, contact int, x_um double, y_um double, radius_um double, device_channel int")
