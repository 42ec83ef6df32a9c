"""Clinical views over event tables in the usual narrow layout, and the hourly score from raw tables.

Tables are DataFrames: stays (subject_id, hadm_id, icustay_id), cohort (hadm_id, icustay_id, excluded, ...), chart, labs,
outputs, inputs and procedures with itemid, charttime, value, valuenum. Each view is one aggregate over rows that a list
of measurements has labelled; joins are equal on the stay first, and times are matched by sequence or by bounds.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import extracted
from pulsegrid.operators import joins
from pulsegrid.plans import severity


class Measure(NamedTuple):
    """Items of one label, with bounds on the value: over low, and under high or (closed) up to it."""

    label: str
    items: tuple[int, ...]
    low: float | None = None
    high: float | None = None
    closed: bool = False


# Item numbers and plausible ranges of the source systems.
VITALS = (
    Measure("HeartRate", (211, 220045), 0, 300),
    Measure("SysBP", (51, 442, 455, 6701, 220179, 220050), 0, 400),
    Measure("DiasBP", (8368, 8440, 8441, 8555, 220180, 220051), 0, 300),
    Measure("MeanBP", (456, 52, 6702, 443, 220052, 220181, 225312), 0, 300),
    Measure("RespRate", (615, 618, 220210, 224690), 0, 70),
    Measure("TempF", (223761, 678), 70, 120),
    Measure("TempC", (223762, 676), 10, 50),
    Measure("SpO2", (646, 220277), 0, 100, True),
    Measure("Glucose", (807, 811, 1529, 3745, 3744, 225664, 220621, 226537), 0),
)
LABS = (
    Measure("ANIONGAP", (50868,), 0, 10000, True),
    Measure("ALBUMIN", (50862,), 0, 10, True),
    Measure("BANDS", (51144,), 0, 100, True),
    Measure("BICARBONATE", (50882,), 0, 10000, True),
    Measure("BILIRUBIN", (50885,), 0, 150, True),
    Measure("CREATININE", (50912,), 0, 150, True),
    Measure("CHLORIDE", (50806, 50902), 0, 10000, True),
    Measure("GLUCOSE", (50809, 50931), 0, 10000, True),
    Measure("HEMATOCRIT", (50810, 51221), 0, 100, True),
    Measure("HEMOGLOBIN", (50811, 51222), 0, 50, True),
    Measure("LACTATE", (50813,), 0, 50, True),
    Measure("PLATELET", (51265,), 0, 10000, True),
    Measure("POTASSIUM", (50822, 50971), 0, 30, True),
    Measure("PTT", (51275,), 0, 150, True),
    Measure("INR", (51237,), 0, 50, True),
    Measure("PT", (51274,), 0, 150, True),
    Measure("SODIUM", (50824, 50983), 0, 200, True),
    Measure("BUN", (51006,), 0, 300, True),
    Measure("WBC", (51300, 51301), 0, 1000, True),
)
GASES = (
    Measure("SPECIMEN", (50800,)),
    Measure("AADO2", (50801,)),
    Measure("BASEEXCESS", (50802,)),
    Measure("BICARBONATE", (50803,)),
    Measure("TOTALCO2", (50804,)),
    Measure("CARBOXYHEMOGLOBIN", (50805,)),
    Measure("CHLORIDE", (50806,)),
    Measure("CALCIUM", (50808,)),
    Measure("GLUCOSE", (50809,)),
    Measure("HEMATOCRIT", (50810,)),
    Measure("HEMOGLOBIN", (50811,)),
    Measure("INTUBATED", (50812,)),
    Measure("LACTATE", (50813,)),
    Measure("METHEMOGLOBIN", (50814,)),
    Measure("O2FLOW", (50815,)),
    Measure("FIO2", (50816,)),
    Measure("SO2", (50817,)),
    Measure("PCO2", (50818,)),
    Measure("PEEP", (50819,)),
    Measure("PH", (50820,)),
    Measure("PO2", (50821,)),
    Measure("POTASSIUM", (50822,)),
    Measure("REQUIREDO2", (50823,)),
    Measure("SODIUM", (50824,)),
    Measure("TEMPERATURE", (50825,)),
    Measure("TIDALVOLUME", (50826,)),
    Measure("VENTILATIONRATE", (50827,)),
    Measure("VENTILATOR", (50828,)),
)
GAS_LIMITS = {"HEMATOCRIT": (0, 100), "FIO2": (20, 100), "SO2": (0, 100), "O2FLOW": (0, 70), "PO2": (0, 800)}
FIO2_FRACTION, FIO2_PLAIN, FIO2_SET = 223835, (3420, 3422), 190
SPECIMEN_MODEL = {  # weight, mean, and what a missing value adds
    "SPO2": (-0.15356, 97.49420, 0.13429), "FIO2_CHART": (0.00621, 51.49550, -0.24958), "HEMOGLOBIN": (0.10559, 10.32307, 0.05954), "SO2": (0.13251, 93.66539, -0.23172), "PCO2": (-0.01511, 42.08866, -0.01630), "FIO2": (0.01480, 63.97836, -0.31142),
    "AADO2": (-0.00200, 442.21186, -0.01328), "BICARBONATE": (-0.03220, 22.96894, -0.06535), "TOTALCO2": (0.05384, 24.72632, -0.01405), "LACTATE": (0.08202, 3.06436, 0.06038), "PH": (0.10956, 7.36233, -0.00617), "O2FLOW": (0.00848, 7.59362, -0.35803),
}
SPECIMEN_CONSTANT, SPECIMEN_PO2 = -0.02544, 0.04598
URINE = (40055, 43175, 40069, 40094, 40715, 40473, 40085, 40057, 40056, 40405, 40428, 40086, 40096, 40651, 226559, 226560, 226561, 226584, 226563, 226564, 226565, 226567, 226557, 226558, 227488, 227489)
IRRIGANT = 227488
COMA = {"motor": (454, 223901), "verbal": (723, 223900), "eyes": (184, 220739)}
COMA_TUBE = ((723, "1.0 ET/Trach"), (223900, "No Response-ETT"))
VENT_ITEMS = (
    445, 448, 449, 450, 1340, 1486, 1600, 224687, 639, 654, 681, 682, 683, 684, 224685, 224684, 224686, 218, 436, 535, 444, 224697, 224695, 224696, 224746, 224747,
    221, 1, 1211, 1655, 2000, 226873, 224738, 224419, 224750, 227187, 543, 5865, 5866, 224707, 224709, 224705, 224706, 60, 437, 505, 506, 686, 220339, 224700, 3459, 501, 502, 503, 224702, 223, 667, 668, 669, 670, 671, 672, 224701,
)
VENT_TYPE, VENT_MODE, VENT_KIND, O2_DEVICE, O2_DEVICES, EXTUBATED = 720, 223849, 223848, 467, 226732, 640
O2_OTHER = (468, 469, 470, 471, 227287, 223834)
O2_BY_DEVICES = ("Nasal cannula", "Face tent", "Aerosol-cool", "Trach mask ", "High flow neb", "Non-rebreather", "Venti mask ", "Medium conc mask ", "T-piece", "High flow nasal cannula", "Ultrasonic neb", "Vapomist")
O2_BY_DEVICE = ("Cannula", "Nasal Cannula", "None", "Face Tent", "Aerosol-Cool", "Trach Mask", "Hi Flow Neb", "Non-Rebreather", "Venti Mask", "Medium Conc Mask", "Vapotherm", "T-Piece", "Hood", "Hut", "TranstrachealCat", "Heated Neb", "Ultrasonic Neb")
EXTUBATIONS, UNPLANNED = (227194, 225468, 225477), 225468
WEIGHT_KG, WEIGHT_LB, WEIGHT_OZ = (762, 763, 3723, 3580, 226512), 3581, 3582
LB, OZ = 0.45359237, 0.0283495231
PRESSORS_CV = {"norepinephrine": ((30047,), (30120,)), "epinephrine": ((30044,), (30119, 30309)), "dopamine": ((), (30043, 30307)), "dobutamine": ((), (30042, 30306))}  # by minute, by kg and minute
PRESSORS_MV = {"norepinephrine": 221906, "epinephrine": 221289, "dopamine": 221662, "dobutamine": 221653}

IDS = ("subject_id", "hadm_id", "icustay_id")


def eligible(stays: DataFrame, cohort: DataFrame) -> DataFrame:
    """Stays of the cohort that aren't excluded."""
    return stays.join(cohort.where("excluded = 0").select("hadm_id", "icustay_id"), ["hadm_id", "icustay_id"]).select(*IDS)


def _valid(events: DataFrame) -> DataFrame:
    return events.where(~F.col("error").eqNullSafe(1)) if "error" in events.columns else events


def _inside(m: Measure, v: Column) -> Column:
    ok = v > m.low if m.low is not None else F.lit(True)
    if m.high is not None:
        ok = ok & ((v <= m.high) if m.closed else (v < m.high))
    return ok


def labelled(events: DataFrame, measures: tuple[Measure, ...]) -> DataFrame:
    """Rows of the measures' items with label; a value out of its range is null."""
    v, item = F.col("valuenum"), F.col("itemid")
    label = F.coalesce(*(F.when(item.isin(*m.items), m.label) for m in measures))
    value = F.coalesce(*(F.when(item.isin(*m.items) & _inside(m, v), v) for m in measures))
    return events.where(item.isin(*(i for m in measures for i in m.items))).withColumns({"label": label, "valuenum": value})


def _pivot(rows: DataFrame, names: tuple[str, ...], how: dict) -> DataFrame:
    pick = lambda n: F.when(F.col("label") == n, F.col("valuenum"))
    return rows.groupBy(*IDS, "charttime").agg(*(f(pick(n)).alias(f"{n}_{k}") for n in names for k, f in how.items()))


def vitals(stays: DataFrame, cohort: DataFrame, chart: DataFrame) -> DataFrame:
    """Minimum, maximum and mean of eight vital signs per stay and time; temperatures in Celsius."""
    rows = labelled(_valid(chart), VITALS)
    warm = F.col("label") == "TempF"
    rows = rows.withColumns({"valuenum": F.when(warm, (F.col("valuenum") - 32) / 1.8).otherwise(F.col("valuenum")), "label": F.when(warm, "TempC").otherwise(F.col("label"))})
    names = tuple(m.label for m in VITALS if m.label != "TempF")
    return _pivot(eligible(stays, cohort).join(rows, list(IDS)), names, {"Min": F.min, "Max": F.max, "Mean": F.avg})


def labs(stays: DataFrame, cohort: DataFrame, lab: DataFrame) -> DataFrame:
    """Minimum and maximum of laboratory values; stays without any keep one row."""
    rows = labelled(lab.where("valuenum > 0"), LABS).select("subject_id", "hadm_id", "charttime", "label", "valuenum")
    return _pivot(eligible(stays, cohort).join(rows, ["subject_id", "hadm_id"], "left"), tuple(m.label for m in LABS), {"Min": F.min, "Max": F.max})


def blood_gas(stays: DataFrame, cohort: DataFrame, lab: DataFrame) -> DataFrame:
    """Values of one blood gas per stay and time; SPECIMEN is text."""
    item = F.col("itemid")
    rows = lab.where(item.between(50800, 50828) | (item == 51545))  # items of no label keep their times too
    label = F.coalesce(*(F.when(item.isin(*m.items), m.label) for m in GASES))
    v = F.col("valuenum")
    wrong = v <= 0
    for name, (low, high) in GAS_LIMITS.items():
        wrong = wrong | ((F.col("label") == name) & ((v < low) | (v > high)))
    rows = rows.withColumn("label", label).withColumn("valuenum", F.when(~F.coalesce(wrong, F.lit(False)), v)).select("subject_id", "hadm_id", "charttime", "label", "value", "valuenum")
    met = eligible(stays, cohort).join(rows, ["subject_id", "hadm_id"], "left")
    pick = lambda n, c: F.max(F.when(F.col("label") == n, F.col(c))).alias(n)
    return met.groupBy(*IDS, "charttime").agg(pick("SPECIMEN", "value"), *(pick(m.label, "valuenum") for m in GASES if m.label != "SPECIMEN"))


def arterial(gas: DataFrame, chart: DataFrame) -> DataFrame:
    """Arterial gases with the last SpO2 of 2 hours and the last FiO2 of 4, the predicted specimen and derived values."""
    v, item = F.col("valuenum"), F.col("itemid")
    numbered = lambda x: x.withColumn("seq", F.unix_micros("charttime"))
    spo2 = numbered(chart.where(item.isin(646, 220277)).groupBy("icustay_id", "charttime").agg(F.max(F.when((v > 0) & (v <= 100), v)).alias("SPO2")))
    share = F.when(item == FIO2_FRACTION, F.when((v > 0) & (v <= 1), v * 100).when((v >= 21) & (v <= 100), v)).when(item.isin(*FIO2_PLAIN), v).when((item == FIO2_SET) & (v > 0.20) & (v < 1), v * 100)
    fio2 = numbered(_valid(chart).where(item.isin(FIO2_FRACTION, FIO2_SET, *FIO2_PLAIN)).groupBy("icustay_id", "charttime").agg(F.max(share).alias("FIO2_CHART")))
    bg = gas.where("PO2 is not null").withColumn("seq", F.unix_micros("charttime"))
    for right, name, hours in ((spo2, "SPO2", 2), (fio2, "FIO2_CHART", 4)):
        bg = joins.as_of(bg, right, "icustay_id", "charttime", hours * 3600, name, "seq").withColumnRenamed(f"{name}_as_of", name).drop("matched_ts")
    total = F.lit(SPECIMEN_CONSTANT) + SPECIMEN_PO2 * F.col("PO2")
    for name, (weight, mean, gone) in SPECIMEN_MODEL.items():
        total = total + F.coalesce(weight * F.col(name), F.lit(weight * mean + gone))
    bg = bg.withColumn("SPECIMEN_PROB", 1 / (1 + F.exp(-total)))
    breathed = F.coalesce("FIO2", "FIO2_CHART")
    out = bg.where((F.col("SPECIMEN") == "ART") | (F.col("SPECIMEN_PROB") > 0.75))
    return out.withColumns({
        "SPECIMEN_PRED": F.coalesce("SPECIMEN", F.when(F.col("SPECIMEN_PROB") > 0.75, "ART")),
        "AADO2_calc": breathed / 100 * (760 - 47) - F.col("PCO2") / 0.8 - F.col("PO2"),
        "PaO2FiO2": F.try_divide(100 * F.col("PO2"), breathed),
    }).drop("seq")


def urine_output(stays: DataFrame, cohort: DataFrame, outputs: DataFrame) -> DataFrame:
    rows = eligible(stays, cohort).join(outputs.where(F.col("itemid").isin(*URINE)), list(IDS))
    return rows.groupBy(*IDS, "charttime").agg(F.sum(F.when(F.col("itemid") == IRRIGANT, -F.col("value")).otherwise(F.col("value"))).alias("UrineOutput"))


def coma_scores(chart: DataFrame) -> DataFrame:
    """motor, verbal and eyes per stay and time; verbal 0 stands for a tube. severity.gcs() makes the scale of them."""
    v, item = F.col("valuenum"), F.col("itemid")
    for code, text in COMA_TUBE:
        v = F.when((item == code) & (F.col("value") == text), 0).otherwise(v)
    rows = _valid(chart).where(item.isin(*(i for x in COMA.values() for i in x))).withColumn("v", v)
    return rows.groupBy("icustay_id", "charttime").agg(*(F.max(F.when(item.isin(*items), F.col("v"))).alias(k) for k, items in COMA.items()))


def lowest_coma(scores: DataFrame) -> DataFrame:
    """The row of each stay's lowest scale; of equal ones the first in time."""
    return joins.first_row(severity.gcs(scores), "icustay_id", "gcs", "charttime")


def vent_settings(chart: DataFrame, procedures: DataFrame, cohort: DataFrame) -> DataFrame:
    """Flags per stay and time: ventilated, on oxygen, extubated, by the patient."""
    ok = cohort.where("excluded = 0").select("hadm_id", "icustay_id")
    item, value = F.col("itemid"), F.col("value")
    used = (VENT_TYPE, VENT_MODE, VENT_KIND, O2_DEVICE, O2_DEVICES, EXTUBATED, *O2_OTHER, *VENT_ITEMS)
    rows = _valid(chart).where(value.isNotNull() & item.isin(*used)).join(ok, ["hadm_id", "icustay_id"])
    flag = lambda c: F.max(F.when(c, 1).otherwise(0))
    vent = ((item == VENT_TYPE) & (value != "Other/Remarks")) | ((item == VENT_KIND) & (value != "Other")) | (item == VENT_MODE) | ((item == O2_DEVICE) & (value == "Ventilator")) | item.isin(*VENT_ITEMS)
    oxygen = ((item == O2_DEVICES) & value.isin(*O2_BY_DEVICES)) | ((item == O2_DEVICE) & value.isin(*O2_BY_DEVICE))
    own = (item == EXTUBATED) & (value == "Self Extubation")
    charted = rows.groupBy("icustay_id", "charttime").agg(flag(vent).alias("MechVent"), flag(oxygen).alias("OxygenTherapy"), flag(own | ((item == EXTUBATED) & (value == "Extubated"))).alias("Extubated"), flag(own).alias("SelfExtubated"))
    done = procedures.where(item.isin(*EXTUBATIONS)).join(ok, ["hadm_id", "icustay_id"])
    done = done.select("icustay_id", F.col("starttime").alias("charttime"), F.lit(0).alias("MechVent"), F.lit(0).alias("OxygenTherapy"), F.lit(1).alias("Extubated"), F.when(item == UNPLANNED, 1).otherwise(0).alias("SelfExtubated"))
    return charted.unionByName(done).distinct()


def vent_durations(settings: DataFrame) -> DataFrame:
    """Episodes of ventilation: icustay_id, ventnum, starttime, endtime, duration_hours.

    One begins after an extubation, with oxygen but no ventilation, or over 8 hours after the last ventilated row.
    """
    active = (F.col("MechVent") == 1) | (F.col("Extubated") == 1)
    by = lambda *k: Window.partitionBy("icustay_id", *k).orderBy("charttime")
    s = settings.withColumn("active", active)
    gap = F.unix_micros("charttime") - F.unix_micros(F.when(F.col("MechVent") == 1, F.lag("charttime").over(by("MechVent")))) > 8 * 3_600_000_000
    new = (F.lag("Extubated").over(by("active")) == 1) | ((F.col("MechVent") == 0) & (F.col("OxygenTherapy") == 1)) | gap
    s = s.withColumn("new", F.when(F.coalesce(new, F.lit(False)), 1).otherwise(0))
    s = s.withColumn("num", F.when(F.col("active"), F.sum("new").over(by())))
    e = s.groupBy("icustay_id", "num").agg(F.min("charttime").alias("starttime"), F.max("charttime").alias("endtime"), F.max("MechVent").alias("vent")).where("starttime <> endtime and vent = 1")
    hours = (F.unix_micros("endtime") - F.unix_micros("starttime")) / 3.6e9
    return e.select("icustay_id", F.row_number().over(Window.partitionBy("icustay_id").orderBy("num")).alias("ventnum"), "starttime", "endtime", hours.alias("duration_hours"))


# How the reports of echo exams name their fields.
ECHO_TEXT = {"Indication": r"Indication: (.*?)\n", "BP": r"BP \(mm Hg\): (.*?)\n", "Status": r"Status: (.*?)\n", "Test": r"Test: (.*?)\n", "Doppler": r"Doppler: (.*?)\n", "Contrast": r"Contrast: (.*?)\n", "TechnicalQuality": r"Technical Quality: (.*?)\n"}
ECHO_NUMBERS = {"Height": r"Height: \(in\) (.*?)\n", "Weight": r"Weight \(lb\): (.*?)\n", "BSA": r"BSA \(m2\): (.*?) m2\n", "BPSys": r"BP \(mm Hg\): ([0-9]+)/[0-9]+?\n", "BPDias": r"BP \(mm Hg\): [0-9]+/([0-9]+?)\n", "HR": r"HR \(bpm\): ([0-9]+?)\n"}


def echo(notes: DataFrame, cohort: DataFrame) -> DataFrame:
    """Fields of echo reports; numbers that hold de-identified text are null."""
    ok = cohort.where("excluded = 0").select("hadm_id")
    rows = notes.where("category = 'Echo'").join(ok, "hadm_id")
    clock = extracted("text", r"Date/Time: [\[\]0-9*-]+ at ([0-9:]+)")
    at = F.try_to_timestamp(F.concat(F.date_format("chartdate", "dd-MM-yyyy"), F.lit(" "), clock), F.lit("dd-MM-yyyy H:mm"))
    return rows.select("row_id", "subject_id", "hadm_id", "chartdate", at.alias("charttime"), *(extracted("text", p).alias(n) for n, p in ECHO_TEXT.items()), *(extracted("text", p).try_cast("double").alias(n) for n, p in ECHO_NUMBERS.items()))


def weights(chart: DataFrame) -> DataFrame:
    """Weights in kg: icustay_id, charttime, kg."""
    v, item = F.col("valuenum"), F.col("itemid")
    kg = F.when(item.isin(*WEIGHT_KG), v).when(item == WEIGHT_LB, v * LB).when(item == WEIGHT_OZ, v * OZ)
    return _valid(chart).where(item.isin(*WEIGHT_KG, WEIGHT_LB, WEIGHT_OZ) & (v != 0)).select("icustay_id", "charttime", kg.alias("kg"))


def hourly_weight(grid: DataFrame, chart: DataFrame, stays: DataFrame, echoes: DataFrame) -> DataFrame:
    """The mean weight of the day before each hour's end, or that of the echoes of a week; grid has icustay_id, hr, hour."""
    first, end = F.col("hour") + F.expr("INTERVAL 1 SECOND"), F.col("hour") + F.expr("INTERVAL 1 HOUR")
    w = weights(chart).select("icustay_id", F.col("charttime").alias("wt"), "kg")
    by_chart = grid.join(w, "icustay_id").where((F.col("wt") >= first - F.expr("INTERVAL 1 DAY")) & (F.col("wt") <= end)).groupBy("icustay_id", "hr").agg(F.avg("kg").alias("kg"))
    e = stays.select("icustay_id", "hadm_id").join(echoes.select("hadm_id", F.col("charttime").alias("et"), (F.col("Weight") * LB).alias("ekg")), "hadm_id")
    by_echo = grid.join(e, "icustay_id").where((F.col("et") > first - F.expr("INTERVAL 7 DAYS")) & (F.col("et") < end)).groupBy("icustay_id", "hr").agg(F.avg("ekg").alias("ekg"))
    return grid.join(by_chart, ["icustay_id", "hr"], "left").join(by_echo, ["icustay_id", "hr"], "left").select("icustay_id", "hr", F.coalesce("kg", "ekg").alias("kg"))


def pressors(grid: DataFrame, inputs_cv: DataFrame, inputs_mv: DataFrame, weight: DataFrame) -> DataFrame:
    """Rates of vasopressors as narrow events: icustay_id, charttime, label, value (by kg and minute)."""
    item = F.col("itemid")
    used = [i for a, b in PRESSORS_CV.values() for i in (*a, *b)]
    cv = severity.in_hours(inputs_cv.where(item.isin(*used) & F.col("rate").isNotNull()), grid.select("icustay_id", "start").distinct(), "icustay_id", "charttime", "start").join(weight, ["icustay_id", "hr"], "left")
    label = F.coalesce(*(F.when(item.isin(*a, *b), k) for k, (a, b) in PRESSORS_CV.items()))
    minute = [i for a, _ in PRESSORS_CV.values() for i in a]
    cv = cv.select("icustay_id", "charttime", label.alias("label"), F.when(item.isin(*minute), F.try_divide("rate", "kg")).otherwise(F.col("rate")).alias("value"))
    mv = inputs_mv.where(item.isin(*PRESSORS_MV.values()) & (F.col("statusdescription") != "Rewritten"))
    mv = mv.select("icustay_id", F.col("starttime").alias("charttime"), F.coalesce(*(F.when(item == i, k) for k, i in PRESSORS_MV.items())).alias("label"), F.col("rate").alias("value"))
    return cv.unionByName(mv)


def score_events(art: DataFrame, episodes: DataFrame, vital: DataFrame, lab: DataFrame, urine: DataFrame, coma: DataFrame, drugs: DataFrame) -> DataFrame:
    """All that the score needs, as narrow events: icustay_id, charttime, label, value. coma has gcs."""
    spans = episodes.select("icustay_id", F.col("starttime").alias("start"), F.col("endtime").alias("end"))
    gas = joins.contained(art.select("icustay_id", "charttime", "PaO2FiO2"), spans, "icustay_id", "charttime")
    one = lambda df, label, value: df.select("icustay_id", "charttime", (label if isinstance(label, Column) else F.lit(label)).alias("label"), F.col(value).cast("double").alias("value"))
    parts = [
        one(gas, F.when(F.col("start").isNotNull(), "pao2fio2_vent").otherwise("pao2fio2_novent"), "PaO2FiO2"), one(vital, "meanbp", "MeanBP_Min"), one(lab, "platelet", "PLATELET_Min"), one(lab, "bilirubin", "BILIRUBIN_Max"), one(lab, "creatinine", "CREATININE_Max"),
        one(urine, "urine", "UrineOutput"), one(coma, "gcs", "gcs"), drugs,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("value is not null and charttime is not null")


def hourly_scores(tables: dict[str, DataFrame], *, entire_stay: bool = False) -> DataFrame:
    """Hourly scores of the cohort from the raw tables.

    tables: stays, cohort, chart, labs, outputs, inputs_cv, inputs_mv, procedures, notes. Hours run from 48 before the
    suspected infection for 72, or (entire_stay) from intime to outtime.
    """
    stays, cohort, chart = tables["stays"], tables["cohort"], tables["chart"]
    chosen = cohort.where("excluded = 0")
    if entire_stay:
        n = F.round((F.unix_timestamp("outtime") - F.unix_timestamp("intime")) / 3600)
        spans = chosen.select("icustay_id", F.col("intime").alias("start"), n.alias("hours"))
    else:
        at = F.col("suspected_infection_time_poe")
        spans = chosen.where(at.isNotNull()).select("icustay_id", (at - F.expr("INTERVAL 48 HOURS")).alias("start"), F.lit(72).alias("hours"))
    grid = severity.hour_grid(spans, "icustay_id", "start", F.col("hours")).withColumn("hour", F.col("start") + F.make_dt_interval(hours=F.col("hr")))
    weight = hourly_weight(grid, chart, stays, echo(tables["notes"], cohort))
    # Each hour is scored by itself: what is missing isn't carried over from the hour before.
    coma = severity.gcs(severity.in_hours(coma_scores(chart), spans, "icustay_id", "charttime", "start"), ("icustay_id", "hr"))
    events = score_events(
        arterial(blood_gas(stays, cohort, tables["labs"]), chart), vent_durations(vent_settings(chart, tables["procedures"], cohort)), vitals(stays, cohort, chart), labs(stays, cohort, tables["labs"]),
        urine_output(stays, cohort, tables["outputs"]), coma, pressors(grid, tables["inputs_cv"], tables["inputs_mv"], weight),
    )
    return severity.hourly_sofa(spans, events, hours=F.col("hours"))


def onsets(cohort: DataFrame, scores: DataFrame) -> DataFrame:
    """A row a stay whose score rises by 2 over its first hour's: both scores, the parts at the onset, and its time."""
    by = Window.partitionBy("icustay_id").orderBy("hr")
    parts = ("respiration", "coagulation", "liver", "cardiovascular", "cns", "renal")
    up = scores.withColumn("initial_sofa_score", F.first("sofa").over(by)).where(F.col("sofa") - F.col("initial_sofa_score") >= 2)
    first = joins.first_row(up, "icustay_id", "hr")
    at = (F.col("start") + F.make_dt_interval(hours=F.col("hr"))).alias("sepsis_onset_time")
    named = first.select("icustay_id", "initial_sofa_score", F.col("sofa").alias("onsettime_sofa_score"), *(F.col(p).alias(f"onsettime_{p}") for p in parts), at)
    return cohort.select("hadm_id", "icustay_id", "intime", "outtime").join(named, "icustay_id")


def hourly_table(cohort: DataFrame, scores: DataFrame) -> DataFrame:
    """The scores with what names their stay and window, one row a stay and hour."""
    at = (F.col("start") + F.make_dt_interval(hours=F.col("hr"))).alias("calculation_time")
    parts = ("respiration", "coagulation", "liver", "cardiovascular", "cns", "renal")
    known = cohort.select("hadm_id", "icustay_id", "subject_id", "intime", "outtime", F.col("suspected_infection_time_poe").alias("suspection_of_infection_time"))
    by = Window.partitionBy("icustay_id")
    end = (F.col("start") + F.make_dt_interval(hours=F.max("hr").over(by) + 1)).alias("window_end_time")
    return known.join(scores.select("icustay_id", F.col("start").alias("window_start_time"), end, at, F.col("sofa").alias("sofa_score"), *parts), "icustay_id")


def materialise(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> dict[str, DataFrame]:
    """Write derived tables as a whole, one Parquet folder each, and read them again; each is a temporary view by its name.

    This stands for creating and refreshing tables and materialised views: a refresh writes all rows anew.
    """
    out = {}
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")
        out[name] = df.sparkSession.read.parquet(f"{path}/{name}")
        out[name].createOrReplaceTempView(name)
    return out


def with_onset(cohort: DataFrame, scores: DataFrame) -> DataFrame:
    """cohort with sepsis_onset_hr: the first hour whose score is 2 over that of the first hour."""
    onset = severity.onset(scores, "icustay_id", "hr", "sofa", 2).withColumnRenamed("hr", "sepsis_onset_hr")
    return cohort.join(onset, "icustay_id", "left")
