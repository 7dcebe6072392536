"""Features across tables and windows, from a table of formulas over long feature names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import KEY

# Name and formula of each cross feature; table/window/column stands for the feature table_window_column.
FORMULAS = {
    "sleep_night_screen_minutes": "mScreenStatus/late_00_03/m_screen_use_sum + mScreenStatus/deep_03_06/m_screen_use_sum",
    "sleep_prebed_screen_ratio": "mScreenStatus/prebed_21_24/m_screen_use_mean",
    "sleep_charging_overnight_ratio": "mACStatus/sleep_21_09/m_charging_mean",
    "sleep_charging_break_proxy": "abs(mACStatus/prebed_21_24/m_charging_mean - mACStatus/wake_06_09/m_charging_mean)",
    "sleep_light_spike": "mLight/late_00_03/m_light_max + wLight/late_00_03/w_light_max + mLight/deep_03_06/m_light_max + wLight/deep_03_06/w_light_max",
    "sleep_late_steps_sum": "wPedo/late_00_03/step_sum + wPedo/deep_03_06/step_sum",
    "sleep_wake_hr_rise": "wHr/wake_06_09/heart_rate_mean_mean - wHr/deep_03_06/heart_rate_mean_mean",
    "sleep_hr_spike_proxy": "wHr/sleep_21_09/heart_rate_spike_mean",
    "mobility_daily_radius": "mGps/daily_00_24/gps_mobility_radius_mean",
    "mobility_prebed_home_distance": "mGps/prebed_21_24/gps_home_distance_mean",
    "mobility_late_home_distance": "mGps/late_00_03/gps_home_distance_mean",
    "mobility_day_speed": "mGps/day_09_18/gps_speed_mean_mean",
    "mobility_wifi_familiar_ratio": "mWifi/daily_00_24/wifi_familiar_ratio_mean",
    "mobility_ble_density_evening": "mBle/evening_18_21/ble_detected_count_mean",
    "mobility_novel_place_proxy": "mWifi/daily_00_24/wifi_novel_ratio_mean + mBle/daily_00_24/ble_novel_ratio_mean",
    "social_day_speech": "mAmbience/day_09_18/ambience_speech_score_mean",
    "social_evening_music": "mAmbience/evening_18_21/ambience_music_score_mean",
    "social_sleep_silence": "mAmbience/sleep_21_09/ambience_silence_score_mean",
    "social_sleep_noise": "mAmbience/sleep_21_09/ambience_sleep_noise_score_mean",
    "social_vehicle_commute": "mAmbience/day_09_18/ambience_vehicle_score_mean + mAmbience/evening_18_21/ambience_vehicle_score_mean",
    "social_isolation_proxy": "mAmbience/daily_00_24/ambience_silence_score_mean - mAmbience/daily_00_24/ambience_speech_score_mean",
    "app_late_social_time": "mUsageStats/late_00_03/usage_social_time_sum",
    "app_prebed_media_time": "mUsageStats/prebed_21_24/usage_media_time_sum",
    "app_day_communication_time": "mUsageStats/day_09_18/usage_communication_time_sum",
    "app_game_time_ratio": "mUsageStats/daily_00_24/usage_game_time_sum / (mUsageStats/daily_00_24/usage_total_time_sum + 1e-6)",
    "app_passive_vs_communication": "(mUsageStats/daily_00_24/usage_media_time_sum + mUsageStats/daily_00_24/usage_social_time_sum) / (mUsageStats/daily_00_24/usage_communication_time_sum + 1e-6)",
    "app_top_concentration": "mUsageStats/daily_00_24/usage_top_app_time_ratio_mean",
    "physio_resting_hr": "wHr/deep_03_06/heart_rate_p10_mean",
    "physio_hr_day_sleep_ratio": "wHr/day_09_18/heart_rate_mean_mean / (wHr/sleep_21_09/heart_rate_mean_mean + 1e-6)",
    "physio_morning_steps": "wPedo/wake_06_09/step_sum",
    "physio_day_step_fraction": "wPedo/day_09_18/step_sum / (wPedo/daily_00_24/step_sum + 1e-6)",
    "physio_late_step_fraction": "(wPedo/late_00_03/step_sum + wPedo/deep_03_06/step_sum) / (wPedo/daily_00_24/step_sum + 1e-6)",
    "screen_evening_sum": "mScreenStatus/evening_18_21/m_screen_use_sum",
    "screen_wake_ratio": "mScreenStatus/wake_06_09/m_screen_use_mean / (mScreenStatus/daily_00_24/m_screen_use_mean + 1e-6)",
    "screen_sleep_total": "mScreenStatus/sleep_21_09/m_screen_use_sum",
    "app_routine_health_time": "mUsageStats/daily_00_24/usage_routine_health_time_sum",
    "app_evening_social_time": "mUsageStats/evening_18_21/usage_social_time_sum",
    "app_night_game_time": "mUsageStats/late_00_03/usage_game_time_sum + mUsageStats/deep_03_06/usage_game_time_sum",
    "app_social_evening_shift": "mUsageStats/evening_18_21/usage_social_time_sum / (mUsageStats/day_09_18/usage_social_time_sum + 1e-6)",
    "cross_hr_screen_day": "wHr/day_09_18/heart_rate_mean_mean * mScreenStatus/daily_00_24/m_screen_use_mean",
    "cross_mobility_step_ratio": "mGps/daily_00_24/gps_mobility_radius_mean / (wPedo/daily_00_24/step_sum + 1e-6)",
    "cross_sleep_disturbance": "mLight/sleep_21_09/m_light_max + wHr/sleep_21_09/heart_rate_spike_mean",
    "cross_social_activity": "mBle/daily_00_24/ble_detected_count_mean * mGps/daily_00_24/gps_mobility_radius_mean",
}
PREFIX = "semantic_"
_INPUT = re.compile(r"\w+/\w+/\w+")


def inputs(formulas: dict[str, str] = FORMULAS) -> list[str]:
    return sorted({m.replace("/", "_") for f in formulas.values() for m in _INPUT.findall(f)})


def cross_features(features: DataFrame, formulas: dict[str, str] = FORMULAS) -> DataFrame:
    """The formulas' values, long, for every key of ``features`` (key, feature, value).

    An input that no row of the data has counts as 0; one that a key lacks makes the result null, which has no row.
    """
    names = inputs(formulas)
    used = features.where(F.col("feature").isin(names))
    present = {r["feature"] for r in used.select("feature").distinct().collect()}  # at most as many as there are inputs
    wide = features.groupBy(*KEY).agg(*[F.max(F.when(F.col("feature") == n, F.col("value"))).alias(n) for n in names if n in present] or [F.lit(0).alias("_none")])

    def expression(text: str):
        return F.expr(_INPUT.sub(lambda m: f"`{n}`" if (n := m[0].replace("/", "_")) in present else "0.0D", text)).cast("double")

    each = F.array(*[F.struct(F.lit(PREFIX + n).alias("feature"), expression(f).alias("value")) for n, f in formulas.items()])
    return wide.select(*KEY, F.explode(each).alias("_f")).select(*KEY, "_f.*").where("value is not null")
