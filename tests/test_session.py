from veilframe.session import JOB_CONF, ensure_checkpoint_dir
from veilframe.streaming.jobs import shared_path


def test_checkpoint_dir_is_read_not_replaced(spark):
    first = ensure_checkpoint_dir(spark)
    assert first and spark.sparkContext.getCheckpointDir() == first
    assert ensure_checkpoint_dir(spark) == first  # an existing setting is kept as-is
    p = shared_path(spark, "probe")
    assert p.startswith(first.rstrip("/")) or p.startswith(first.replace("file:", ""))


def test_job_settings_are_applied(spark):
    for k in ("spark.sql.adaptive.enabled", "spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit"):
        assert spark.conf.get(k) == JOB_CONF[k]
