"""Fixed values."""

# Two-sided 95 % Student t quantiles t(0.975, df), df = 1..30.
T_975 = [
    12.706204736432095, 4.302652729911275, 3.182446305284263, 2.7764451051977987,
    2.5705818366147395, 2.4469118487916806, 2.3646242510102993, 2.306004135033371,
    2.2621571627409915, 2.2281388519649385, 2.200985160082949, 2.1788128296634177,
    2.1603686564610127, 2.1447866879169273, 2.131449545559323, 2.1199052992210112,
    2.1098155778331806, 2.10092204024096, 2.093024054408263, 2.0859634472658364,
    2.079613844727662, 2.0738730679040147, 2.0686576104190406, 2.0638985616280205,
    2.059538552753294, 2.055529438642871, 2.0518305164802833, 2.048407141795244,
    2.045229642132703, 2.042272456301238,
]

# Standard normal quantile z(0.975), the centre of the expansion used past the table.
Z_975 = 1.959963984540054

# Prefix of the per-entity group key given to entities without one.
SOLO_PREFIX = "ACYCLIC:"

# Fractions of entities wanted in train and valid; the rest is test.
TRAIN_FRACTION = 0.70
VALID_FRACTION = 0.15

# Seeds of the five repeated partitions.
SEEDS = [42, 100, 3544, 2025, 2026]

# Nominal coverage of the calibrated intervals.
COVERAGE = 0.90

# Tolerance that makes similarity and gap thresholds inclusive.
EPSILON = 1e-12

# Cliff configurations as name -> (least similarity, least gap of the target).
CLIFF_CONFIGS = {
    "primary_sim0.8_delta2": (0.8, 2.0),
    "sensitivity_sim0.7_delta2": (0.7, 2.0),
    "sensitivity_sim0.9_delta2": (0.9, 2.0),
    "sensitivity_sim0.8_delta3": (0.8, 3.0),
}

# Depths of the top-k reports and support thresholds of the sensitivity curve.
TOP_K = [25, 50, 100]
SUPPORT_THRESHOLDS = [1, 10, 20, 50, 100]

# Factor of the molar margin score.
MARGIN_FACTOR = 0.02
