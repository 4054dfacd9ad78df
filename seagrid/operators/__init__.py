"""DataFrame to DataFrame operators."""

from seagrid.operators.align import (
    align_sources, days_with_values, drop_land, pick_source,
)
from seagrid.operators.climatology import climatology
from seagrid.operators.coast import distance_to_coast
from seagrid.operators.confound import (
    fleet_active_months, keep_months, navigable_days, seasonal_profile,
)
from seagrid.operators.daily import daily_stats, daily_wind, daily_wind_components
from seagrid.operators.evaluate import evaluate, evaluate_within, ranking_metrics
from seagrid.operators.fill import fill_nearest, filled, swap_filled
from seagrid.operators.front import gradient, sst_gradient
from seagrid.operators.index import pct_rank, physics_index
from seagrid.operators.isotonic import fit_isotonic, isotonic_blocks
from seagrid.operators.labels import (
    build_report, effort_cells, effort_report, effort_shares, effort_totals,
    flag_share, join_labels, label_match_report,
)
from seagrid.operators.models import (
    compare_models, depth_only, evaluate_models, feature_importance, feature_set, fit_hotspot,
    predict, score_cells, spatial_transfer, validation_gate,
)
from seagrid.operators.planning import (
    calendar_chunks, clamp_windows, coverage_check, expected_sources,
    load_chunks, missing_by_year, missing_sources, pending_chunks,
)
from seagrid.operators.regrid import Axis, regrid_bilinear, unmatched_readings
from seagrid.operators.safety import classify, safety_summary, with_status_text
from seagrid.operators.sampling import (
    calibration_split, cap_rows, exclude_box, holdout_band, period_chunks,
    subsample_negatives, temporal_split, thin_training_years,
)
from seagrid.operators.seabed import (
    depth_report, join_static, pixel_spacing, seabed, seabed_by_spacing,
    seabed_interpolated,
)
from seagrid.operators.series import (
    carry_forward, carry_planes, observed_days, trailing_mean,
)
from seagrid.operators.serving import (
    catalog_status, daily_payload, display_cells, latest_or_fallback,
    lookup_points, point_answers, select_days,
)
from seagrid.operators.tiles import (
    distance_to_coast_tiled, fill_nearest_tiled, in_tiles, pct_rank_ranged,
    physics_index_ranged, sst_gradient_tiled,
)
from seagrid.operators.zones import (
    assign_zones, rank_zones, zone_plane, zone_summary,
)
