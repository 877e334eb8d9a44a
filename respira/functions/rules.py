"""Rule classifiers and vocabularies as Column expressions; null inputs give the rule's neutral verdict, never null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9

# Category names, label sets and needles of the ventilation-evidence rules.
INVASIVE, NIV, O2, AMBIGUOUS = "invasiva", "vni_alto_flujo", "oxigenoterapia", "ambigua"
CHART_INVASIVE = (
    "Mechanical Ventilator Mode", "Ventilator Support Mode", "Ventilator Type", "PEEP", "Tidal Volume (set)", "Set Vt (Servo,LTV)", "Set Vt (Drager)", "Vti", "Peak Insp. Pressure", "Peak Pressure",
    "Total RR", "Resp Rate Total", "f Total", "Exhaled MV", "Exhaled TV (machine)", "Minute Volume Set(L/min)", "Inspiratory Pressure, Set",
)
CHART_NIV = (
    "NIV Setting EPAP", "NIV Setting Set_RR", "NIV Setting Total RR_5", "NIV Setting Spont Exp Vt_5", "NIV Setting Leak_", "NIV Pt/Vent Spont_TidalV", "NIV Pt/Vent Spont_Rate", "NIV Pt/Vent SpO2_5",
    "NIV Alarms Hi Press Alarm_5", "NIV Alarms Low Press Alarm", "Non-invasive Ventilation Mode", "Bipap Delivery Mode", "CPAP", "EPAP", "IPAP", "PEEP/CPAP", "B2: EPAP", "B1: IPAP", "B3: Est Mask Leak", "PS above PEEP",
)
CHART_O2 = ("LPM O2", "O2 Device", "O2 Percentage", "Oxygen Delivery Method", "Oxygen Delivery Status", "Oxygen Flow Rate", "RETIRED O2 Device", "FiO2", "FIO2 (%)", "Set Fraction of Inspired Oxygen (FIO2)")
NIV_PATTERN = r"(?i)\bniv\b|non[- ]?invasive|bipap|\bcpap\b|\bepap\b|\bipap\b|high[- ]?flow|hfnc"
O2_PATTERN = r"(?i)oxygen|\bo2\b|lpm|nasal cannula|face mask|venturi|oxigen"
AIRWAY_INVASIVE = ("Oral ETT", "Nasal ETT", "Tracheostomy", "Cricothyrotomy", "Double-Lumen Tube", "Laryngectomy")
TREATMENT = {
    INVASIVE: ("ventilation and oxygenation|mechanical ventilation", "radiologic procedures / bronchoscopy|endotracheal tube|insertion", "surgery / incision and drainage of thorax|tracheostomy"),
    NIV: ("ventilation and oxygenation|non-invasive ventilation", "ventilation and oxygenation|cpap/peep therapy"),
    O2: ("ventilation and oxygenation|oxygen therapy", "ventilation and oxygenation|oxygen delivery"),
}
CAREPLAN = {
    INVASIVE: ("mechanical ventilation", "intubat", "endotracheal", "ett", "tracheostomy"),
    NIV: ("non-invasive", "noninvasive", "cpap", "bipap"),
    O2: ("oxygen", "nasal cannula", "face mask", "high flow", "hfnc"),
}
LEVEL_LABELS = ("Mechanical Ventilator Mode", "Ventilator Support Mode", "PEEP", "Tidal Volume (set)", "Set Vt (Servo,LTV)", "Set Vt (Drager)", "Vti", "Peak Insp. Pressure", "Total RR", "Resp Rate Total", "f Total")
EVIDENCE_FLAGS = ("apache_vent", "apache_intub", "airway_ett", "airway_trach", "rc_invasive", "cpg_vent", "tx_vent")
# End reasons, their aliases and priority.
END_REASONS = ("extubation_observed", "transfer_ventilated", "death_at_vent", "terminal_extubation", "tracheostomy", "end_of_record")
REASON_ALIASES = {"trach": "tracheostomy", "trach_time_unknown": "tracheostomy", "trach_preexisting": "tracheostomy", "death": "death_at_vent", "no_successful_extubation": "end_of_record"}
REASON_PRIORITY = ("death_at_vent", "terminal_extubation", "tracheostomy")
# Places where invasive ventilation can't go on, procedure code prefixes, drug patterns, ranges.
INCOMPATIBLE = ("home", "home with home health", "home w/ home health", "home with hospice", "floor", "floor bed", "assisted living", "other", "hospice", "psychiatric hospital", "residential facility")
TRACH_PREFIXES = ("311", "3121", "3129")
DRUGS = (("norepinephrine", r"norepinephrine|norepi\b|levophed"), ("epinephrine", r"(?<!nor)epinephrine\b"), ("dopamine", r"dopamine\b"))
RANGES = {"HR": (20.0, 250.0), "SpO2": (50.0, 100.0)}
# Monitor tracks by variable, preferred ones first.
ALIASES = {
    "HR": ("Intellivue/ECG_HR", "Intellivue/PLETH_HR", "Intellivue/HR"),
    "SpO2": ("Intellivue/PLETH_SAT_O2",),
    "MAP": ("Intellivue/ART_MEAN", "Intellivue/ABP_MEAN", "Intellivue/NIBP_MEAN"),
    "SBP": ("Intellivue/ART_SYS", "Intellivue/ABP_SYS", "Intellivue/NIBP_SYS"),
    "DBP": ("Intellivue/ART_DIA", "Intellivue/ABP_DIA", "Intellivue/NIBP_DIA"),
    "RR": ("Intellivue/RR", "Intellivue/VENT_RR"),
}
# Chart items of a concept, and those of procedures.
CHART_ITEMS = {
    "VentMode": (720, 223849), "PEEP": (505, 506, 686, 224700, 220339), "TV_set": (683, 224684), "TV_observed": (681, 682, 224685, 224686), "PIP": (507, 535, 224695), "RR_V": (224690,), "FiO2": (3420, 223835),
    "MV": (448, 224687), "HR": (220045, 211), "SpO2": (220277, 646), "MAP_invasive": (220052,), "MAP_non_invasive": (220181,), "AirwayType": (40, 223836),
}
PROCEDURE_ITEMS = {"ventilation": (225792,), "tracheostomy": (225448, 226237), "extubation": (227194, 225468, 225477)}
MARKERS = ("VentMode", "PEEP", "TV_set", "TV_observed", "PIP", "RR_V")


def chain(cases: list[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first case that holds; a case that is null does not."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    if not cases:
        return lit(otherwise)
    first, *rest = cases
    out = reduce(lambda c, x: c.when(x[0], lit(x[1])), rest, F.when(first[0], lit(first[1])))
    return out.otherwise(lit(otherwise))


def is_one_of(label: Column, values: tuple) -> Column:
    return F.coalesce(label.isin(*values), F.lit(False))


def _blank(text: Column) -> Column:
    return F.coalesce(F.trim(text) == "", F.lit(True))


def _holds(text: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(n)) for n in needles))


def chart_label(label: Column) -> Column:
    return chain([(_blank(label), AMBIGUOUS), (label.isin(*CHART_INVASIVE), INVASIVE), (label.isin(*CHART_NIV) | label.rlike(NIV_PATTERN), NIV), (label.isin(*CHART_O2) | label.rlike(O2_PATTERN), O2)], AMBIGUOUS)


def airway(value: Column) -> Column:
    return chain([(value.isin(*AIRWAY_INVASIVE), INVASIVE)], AMBIGUOUS)


def treatment(value: Column) -> Column:
    return chain([(_blank(value), AMBIGUOUS)] + [(_holds(value, needles), kind) for kind, needles in TREATMENT.items()], AMBIGUOUS)


def care_plan(group: Column, value: Column) -> Column:
    group, value = F.lower(F.coalesce(group, F.lit(""))), F.coalesce(value, F.lit(""))
    guards = [(~group.isin("ventilation", "airway"), AMBIGUOUS), (_holds(value, ("not intubated", "no artificial")), AMBIGUOUS)]
    return chain(guards + [(_holds(value, needles), kind) for kind, needles in CAREPLAN.items()], AMBIGUOUS)


def any_flag(*flags: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(f, F.lit(False)) for f in flags))


def trach_code(code: Column) -> Column:
    digits = F.regexp_replace(code, "[^0-9]", "")
    return F.coalesce(reduce(lambda a, b: a | b, (F.startswith(digits, F.lit(p)) for p in TRACH_PREFIXES)), F.lit(False))


def trach_text(*values: Column) -> Column:
    return any_flag(*(v.rlike(r"(?i)\btrach\w*") for v in values))


def drug_kind(name: Column) -> Column:
    low = F.lower(name)
    return chain([(low.rlike(p), kind) for kind, p in DRUGS], F.lit(None).cast("string"))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or missing."""
    return F.when(b != 0, a / b)


def plausibility(invasive: Column, total: Column, without: Column, dense: float = 0.6, permeable: float = 0.5) -> Column:
    share = ratio(invasive, total)
    return chain([(share.isNull() | (share <= dense), "ok"), (without >= permeable, "implausible_permeable")], "concentrado_concordante")


def implausible(invasive: Column, total: Column, threshold: float = 0.6) -> Column:
    return F.coalesce(ratio(invasive, total) > threshold, F.lit(False))


def permeability(without: Column, threshold: float = 0.5) -> Column:
    return chain([(without >= threshold, "implausible_permeable")], "ok")


def annotation_stratum(minutes: Column) -> Column:
    """le1h, 1_2h or gt2h; a missing or endless interval counts as the finest."""
    finite = minutes.isNotNull() & ~F.isnan(minutes) & (F.abs(minutes) < F.lit(float("inf")))
    return chain([(~finite | (minutes <= 60), "le1h"), (minutes <= 120, "1_2h")], "gt2h")


def calibration_stratum(minutes: Column) -> Column:
    return chain([(minutes.isNull() | (minutes <= 60), 1), (minutes <= 120, 2)], 4)


def label3(event_type: Column, n_failed: Column) -> Column:
    return chain([(event_type != "successful_extubation", "censored"), (n_failed > 0, "failure_then_success")], "success")


def canonical_reason(reason: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in REASON_ALIASES.items() for x in kv))
    return F.coalesce(table[reason], reason)


def is_canonical(reason: Column) -> Column:
    return is_one_of(reason, END_REASONS)


def end_reason(causes: Column, extubated: Column, fallback: Column) -> Column:
    """Of an array of causes: the one of highest priority, else the observed extubation, else the fallback."""
    canon = F.transform(F.filter(causes, lambda c: c.isNotNull()), canonical_reason)
    return chain([(F.array_contains(canon, r), r) for r in REASON_PRIORITY] + [(extubated, "extubation_observed")], F.coalesce(canonical_reason(fallback), F.lit("end_of_record")))


def incompatible_destination(place: Column) -> Column:
    return is_one_of(F.lower(F.trim(place)), INCOMPATIBLE)


def transfer_proposal(cause: Column, place: Column, gap_h: Column, least: float = 1.0) -> Column:
    return F.when((cause == "transfer_ventilated") & incompatible_destination(place) & (gap_h >= least), "end_of_record")


def variable_of_track(track: Column) -> Column:
    table = F.create_map(*(F.lit(x) for v, tracks in ALIASES.items() for t in tracks for x in (t, v)))
    return table[track]


def track_in_range(track: Column, value: Column) -> Column:
    """Whether the value is physiological for the track's variable (or a variable's name); false without a range."""
    variable = F.coalesce(variable_of_track(track), track)
    return F.coalesce(chain([(variable == v, value.between(lo, hi) & ~F.isnan(value)) for v, (lo, hi) in RANGES.items()], False), F.lit(False))


def artifact_verdict(percent: Column, low: float = 2.0, high: float = 30.0) -> Column:
    return chain([(percent > high, "too_high"), (percent < low, "too_low")], "ok")


def short_event(awp_ptp: Column, awp_cycles: Column, tv_median: Column, n_markers: Column) -> tuple[Column, Column]:
    """(plausible, reasons) of a short event by its pressure wave, tidal volume and documented settings."""
    tv_ok = F.coalesce(tv_median.between(50.0, 1500.0), F.lit(False))
    wide, cyclic = F.coalesce(awp_ptp >= 5.0, F.lit(False)), F.coalesce(awp_cycles >= 2, F.lit(False)) & awp_ptp.isNotNull()
    marked = F.coalesce(n_markers >= 2, F.lit(False))
    reasons = F.array(
        F.when(awp_ptp.isNull(), "sin_awp").when(wide, "awp_amplitud").otherwise("awp_plana"), F.when(cyclic, "awp_ciclica"), F.when(tv_ok, "tv_presente"), F.when(marked, "ajustes_presentes"),
    )
    plausible = (wide & cyclic) | (tv_ok & F.coalesce(awp_ptp >= 2.0, F.lit(False))) | marked
    return plausible, F.filter(reasons, lambda r: r.isNotNull())


def simultaneous(a_h: Column, b_h: Column, minutes: float = 15.0) -> Column:
    return F.coalesce(F.abs(a_h - b_h) * 60 <= minutes, F.lit(False))


def all_above(coverage: Column, threshold: float) -> Column:
    """Whether every value of a map is strictly above; an empty map is not."""
    values = F.map_values(coverage)
    return F.coalesce((F.size(values) > 0) & F.forall(values, lambda v: v > threshold), F.lit(False))


def stay_level(start: Column, end: Column, documented: Column, discharge: Column, trach: Column, last_adj: Column, cause: Column, extubated: Column, coherence: float = 4.0, recovery: float = 1.0) -> Column:
    """Completeness of a stay's documentation: a struct of level, reason, proposed shift. cause, extubated: of rule 0."""
    valid = extubated | cause.isin("death_at_vent", "transfer_ventilated") | F.coalesce(trach <= end + EPS, F.lit(False))
    in_range = (end > start + EPS) & (end <= discharge + EPS)
    known = F.coalesce(documented, F.lit(False)) & F.coalesce(in_range, F.lit(False)) & F.coalesce(valid, F.lit(False))
    has = last_adj.isNotNull()
    coherent = F.coalesce((end - last_adj >= 0) & (end - last_adj <= coherence + EPS), F.lit(False))
    saved = F.coalesce((last_adj <= end + EPS) & (start - EPS <= last_adj) & (discharge - last_adj >= recovery - EPS), F.lit(False))
    level = chain([(known & ~has, "B"), (known & coherent, "A"), (saved, "C")], "D")
    reason = chain(
        [(known & ~has, "documentada_sin_ajustes"), (known & coherent, "documentada_y_verificada"), (known & saved, "documentada_incoherente_rescatable"), (known, "documentada_incoherente_no_rescatable"), (saved, "fin_imputado_rescatable")],
        "fin_imputado_no_rescatable",
    )
    return F.struct(level.alias("level"), reason.alias("reason"), F.when(level == "C", end - last_adj).alias("proposed_shift_h"))


def scenario_a(n: Column, peak: Column) -> Column:
    return (n >= 10) & (F.coalesce(ratio(peak, n), F.lit(0.0)) >= 0.10)


def scenario_b(stays: Column, invasive_share: Column, median_gap: Column, most: float) -> Column:
    return (stays >= 50) & (F.coalesce(invasive_share, F.lit(0.0)) >= 0.80) & F.coalesce(median_gap <= most, F.lit(False))


def scenario_d(stays: Column, invasive_share: Column, median_gap: Column, n_ok: Column, least: float = 0.70) -> Column:
    return scenario_b(stays, invasive_share, median_gap, 240.0) & (n_ok / F.greatest(stays, F.lit(1)) >= least)
