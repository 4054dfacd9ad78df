"""All thresholds, small dimensions and labels, as one immutable value."""

from __future__ import annotations

from dataclasses import dataclass

# Safety states, their display labels, colours and advice.
SAFE = "AMMAAN"
CAUTION = "TAXADDAR"
DANGER = "KHATAR"
UNKNOWN = "LAMA_OGA"

STATUS_TEXT = (
    # status, Somali label, English label, colour, Somali advice, English advice
    (SAFE, "Ammaan", "Safe", "#1a9850",
     "Xaaladda badda way fiican tahay maanta.",
     "Sea conditions are good today."),
    (CAUTION, "Taxaddar", "Caution", "#fee08b",
     "Badda waa kacsan tahay. Doonyaha yaryar ha bixin.",
     "The sea is rough. Small boats should stay in."),
    (DANGER, "Khatar", "Dangerous", "#d73027",
     "KHATAR: Ha bixin badda maanta.",
     "DANGER: Do not go to sea today."),
    (UNKNOWN, "Lama oga", "Unknown", "#999999",
     "Xogta badda lama helin. Ka digtoonow.",
     "Sea data unavailable. Be cautious."),
)

# Landing sites (id, Somali name, English name, lat, lon).
LANDING_SITES = (
    ("boosaaso", "Boosaaso", "Bosaso", 11.284, 49.182),
    ("caluula", "Caluula", "Alula", 11.966, 50.757),
    ("qandala", "Qandala", "Qandala", 11.472, 49.874),
    ("berbera", "Berbera", "Berbera", 10.435, 45.016),
    ("eyl", "Eyl", "Eyl", 7.981, 49.816),
    ("garacad", "Garacad", "Garacad", 6.964, 49.371),
    ("hobyo", "Hobyo", "Hobyo", 5.351, 48.527),
    ("cadale", "Cadale", "Adale", 2.747, 46.309),
    ("muqdisho", "Muqdisho", "Mogadishu", 2.037, 45.343),
    ("marka", "Marka", "Merca", 1.716, 44.771),
    ("baraawe", "Baraawe", "Brava", 1.112, 44.028),
    ("kismaayo", "Kismaayo", "Kismayo", -0.358, 42.545),
)

# Distance-from-coast bands [low, high) in km and their names.
COAST_BANDS = (
    (0, 15, "Xeebta", "Inshore"),
    (15, 35, "Dhexe", "Mid-shore"),
    (35, 80, "Dibadda", "Offshore"),
)

# Rating of a zone score (lowest score, level, Somali, English).
RATINGS = (
    (70, "high", "Rajo fiican", "Promising"),
    (45, "mid", "Dhexdhexaad", "Moderate"),
    (None, "low", "Rajo yar", "Poor"),
)
RATING_UNKNOWN = ("unknown", "Lama oga", "Unknown")

# The sources each mode expects
# (mode, source, dataset id, variables, cadence).
EXPECTED_SOURCES = (
    ("historical", "sst", "METOFFICE-GLO-SST-L4-REP-OBS-SST",
     ("analysed_sst",), "P1D"),
    ("historical", "chl",
     "cmems_obs-oc_glo_bgc-plankton_my_l4-gapfree-multi-4km_P1D",
     ("CHL",), "P1D"),
    ("historical", "phy", "cmems_mod_glo_phy_my_0.083deg_P1D-m",
     ("uo", "vo", "thetao"), "P1D"),
    ("historical", "wav", "cmems_mod_glo_wav_my_0.2deg_PT3H-i",
     ("VHM0",), "PT3H"),
    ("historical", "wnd", "cmems_obs-wind_glo_phy_my_l4_0.125deg_PT1H",
     ("eastward_wind", "northward_wind"), "PT1H"),
    ("nrt", "sst", "METOFFICE-GLO-SST-L4-NRT-OBS-SST-V2",
     ("analysed_sst",), "P1D"),
    ("nrt", "chl",
     "cmems_obs-oc_glo_bgc-plankton_my_l4-gapfree-multi-4km_P1D",
     ("CHL",), "P1D"),
    ("nrt", "cur", "cmems_mod_glo_phy-cur_anfc_0.083deg_P1D-m",
     ("uo", "vo"), "P1D"),
    ("nrt", "thetao", "cmems_mod_glo_phy-thetao_anfc_0.083deg_P1D-m",
     ("thetao",), "P1D"),
    ("nrt", "wav", "cmems_mod_glo_wav_anfc_0.083deg_PT3H-i",
     ("VHM0",), "PT3H"),
    ("nrt", "wnd", "cmems_obs-wind_glo_phy_nrt_l4_0.125deg_PT1H",
     ("eastward_wind", "northward_wind"), "PT1H"),
)
TRAINING_SOURCES = ("sst", "chl", "phy")
SUBDAILY_SOURCES = ("wav", "wnd")


@dataclass(frozen=True)
class Rules:
    # Sea state
    wave_safe_m: float = 1.25
    wave_danger_m: float = 2.0
    wind_safe_kmh: float = 20.0
    wind_danger_kmh: float = 30.0
    area_danger_share: float = 0.15
    area_caution_share: float = 0.30
    area_unknown_share: float = 0.5
    zone_danger_share: float = 0.34
    zone_safe_share: float = 0.5
    zone_unknown_share: float = 0.5
    # Reach of a small boat
    max_coast_km: float = 50.0
    max_trip_km: float = 80.0
    boat_speed_kmh: float = 18.0
    # Gap handling
    wave_fill_max_km: float = 30.0
    chl_max_age_days: int = 21
    chl_lookback_days: int = 40
    # Index weights
    chl_weight: float = 0.55
    front_weight: float = 0.45
    # Labels and validation
    fished_hours: float = 0.5
    active_min_rate: float = 0.002
    uniform_spread: float = 0.2
    dormant_months: tuple[int, ...] = (7, 8)
    train_end_year: int = 2023
    holdout_lat: tuple[float, float] = (-2.0, 1.5)
    # Dimensions
    sites: tuple = LANDING_SITES
    bands: tuple = COAST_BANDS


RULES = Rules()
