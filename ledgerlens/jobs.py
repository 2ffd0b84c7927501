"""Every job by name. Each takes a star and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ledgerlens.plans import anomalies, audits, baseline, customers, dashboard, loading, merchants, scoring
from ledgerlens.sources.order_star import damaged_export
from ledgerlens.sources.star import Star

JOBS: dict[str, Callable[[Star], DataFrame]] = {
    # Baseline key figures
    "q01_overall_summary": baseline.overall_summary,
    "q02_monthly_trend": baseline.monthly_trend,
    "q03_channel_breakdown": baseline.channel_breakdown,
    "q04_transaction_type_breakdown": baseline.transaction_type_breakdown,
    "q05_status_breakdown": baseline.status_breakdown,
    "q06_hourly_distribution": baseline.hourly_distribution,
    "q07_segment_breakdown": baseline.segment_breakdown,
    "q08_weekend_vs_weekday": baseline.weekend_vs_weekday,
    "q09_day_of_week_breakdown": baseline.day_of_week_breakdown,
    "q10_country_breakdown": baseline.country_breakdown,
    "q11_city_hotspots": baseline.city_hotspots,
    "q12_high_risk_country_activity": baseline.high_risk_country_activity,
    "q13_high_risk_country_share": baseline.high_risk_country_share,
    "q14_account_type_breakdown": baseline.account_type_breakdown,
    # Anomalies and velocity
    "q15_off_hours_by_hour": anomalies.off_hours_by_hour,
    "q16_off_hours_vs_normal": anomalies.off_hours_vs_normal,
    "q17_off_hours_by_channel": anomalies.off_hours_by_channel,
    "q18_velocity_pairs": anomalies.velocity_pairs_top,
    "q19_velocity_account_summary": anomalies.velocity_account_summary,
    "q20_amount_outliers": anomalies.amount_outliers,
    "q21_daily_spikes": anomalies.daily_spikes,
    "q22_geo_mismatch_transactions": anomalies.geo_mismatch_transactions,
    "q23_geo_mismatch_by_customer": anomalies.geo_mismatch_by_customer,
    # Customers
    "q24_customer_baseline": customers.customer_baseline,
    "q25_high_risk_customers": customers.high_risk_customers,
    "q26_unusual_channel_use": customers.unusual_channel_use,
    "q27_quarter_spend_spike": customers.quarter_spend_spike,
    "q28_dormant_reactivation": customers.dormant_reactivation,
    "q29_kyc_breakdown": customers.kyc_breakdown,
    "q30_customer_watchlist": customers.customer_watchlist,
    # Merchants and channels
    "q31_merchant_overview": merchants.merchant_overview,
    "q32_merchant_risk_ranking": merchants.merchant_risk_ranking,
    "q33_shell_merchants": merchants.shell_merchants,
    "q34_merchant_category_summary": merchants.merchant_category_summary,
    "q35_channel_risk_score": merchants.channel_risk_score,
    "q36_channel_monthly_trend": merchants.channel_monthly_trend,
    "q37_merchant_customer_overlap": merchants.merchant_customer_overlap,
    "q38_merchant_concentration": merchants.merchant_concentration,
    # Scoring
    "q39_customer_amount_stats": scoring.customer_amount_stats,
    "q40_customer_velocity_hits": scoring.customer_velocity_hits,
    "q41_top_risk_customers": scoring.top_risk_customers,
    "q42_risk_tier_summary": scoring.risk_tier_summary,
    "s1_flagged_signal": scoring.flagged_signal,
    "s2_geo_signal": scoring.geo_signal,
    "s3_shell_signal": scoring.shell_signal,
    "s4_amount_signal": scoring.amount_signal,
    "s5_combined_signals": scoring.combined_signals,
    "s6_ntile_scores": scoring.ntile_scores,
    "s7_composite_score": scoring.composite_score,
    "s8_risk_tier": scoring.risk_tier,
    # Dashboard tables
    "d01_kpi_cards": dashboard.kpi_cards,
    "d01_kpi_cards_q3": lambda star: dashboard.kpi_cards(star, quarter=3),
    "d01_kpi_cards_mobile": lambda star: dashboard.kpi_cards(star, channel="Mobile"),
    "d01_kpi_cards_q2_web": lambda star: dashboard.kpi_cards(star, quarter=2, channel="Web"),
    "d02_monthly_volume": dashboard.monthly_volume,
    "d03_flagged_pct_by_channel": dashboard.flagged_pct_by_channel,
    "d04_monthly_kpi_banded": dashboard.monthly_kpi_banded,
    "d05_segment_value_share": dashboard.segment_value_share,
    "d06_off_hours_kpis": dashboard.off_hours_kpis,
    "d07_geo_mismatch_total": dashboard.geo_mismatch_total,
    "d08_shell_txn_total": dashboard.shell_txn_total,
    "d09_hour_flag_histogram": dashboard.hour_flag_histogram,
    "d10_flagged_pct_by_category": dashboard.flagged_pct_by_category,
    "d11_merchant_risk_table": dashboard.merchant_risk_table,
    "d12_channel_hours_matrix": dashboard.channel_hours_matrix,
    "d13_tier_kpis": dashboard.tier_kpis,
    "d14_poor_kyc_customers": dashboard.poor_kyc_customers,
    "d15_dormant_customer_total": dashboard.dormant_customer_total,
    "d16_flagged_pct_by_kyc": dashboard.flagged_pct_by_kyc,
    "d17_tier_distribution": dashboard.tier_distribution,
    "d18_watchlist_top10": dashboard.watchlist_top10,
    "d19_quarter_change": dashboard.quarter_change,
    # Loading and audits
    "a1_load_csv_table": lambda star: loading.load_fact(star.spark, *damaged_export(star)),
    "a2_orphan_audit": audits.orphan_audit,
    "a3_customer_risk_scores": scoring.customer_risk_score_table,
    "a4_reference_number_check": audits.reference_number_check,
}
