"""The shared checkpoint folder comes from the session; a fallback only fills a gap."""

from __future__ import annotations

from marquee.session import BASE_CONF, checkpoint_dir


def test_session_checkpoint_dir_wins_over_fallback(spark, tmp_out):
    current = spark.conf.get("spark.checkpoint.dir")  # set once by the test session fixture
    assert current
    assert checkpoint_dir(spark, fallback=f"{tmp_out}/elsewhere") == current
    assert spark.conf.get("spark.checkpoint.dir") == current


def test_base_settings_keep_ui_off_and_aqe_on():
    assert BASE_CONF["spark.ui.enabled"] == "false"
    assert BASE_CONF["spark.sql.adaptive.enabled"] == "true"
    assert BASE_CONF["spark.sql.adaptive.skewJoin.enabled"] == "true"
