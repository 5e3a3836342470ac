"""The rows of findings are kept once for all that read them."""

from logsentinel import carriers
from logsentinel.plans.analyze import detect_apart
from logsentinel.rules import AlertConfig, AppConfig


def test_rows_of_findings_are_kept(spark):
    config = AppConfig(1, carriers.DAY, AlertConfig(), tuple(carriers.RULES[k] for k in carriers.JOINED))
    _, _, kept = detect_apart(carriers.as_events(spark, "/root/testdata/sf0.001"), config)
    assert len(kept) == 4 and all(df.storageLevel.useMemory for df in kept)  # tags, rows of windows, rows of streaks, findings
    for df in kept:
        df.unpersist()
