"""The clinical views on a made stay, every number by hand."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.plans import clinical_views as V


def made(spark, rows, shape):
    return spark.createDataFrame(rows, shape)


@pytest.fixture(scope="module")
def tables(spark):
    t = lambda df, *c: df.withColumns({x: F.to_timestamp(x) for x in c})
    d = "2100-01-03 "
    ids = (1, 10, 100)
    chart = [
        (*ids, 220052, d + "00:10:00", None, 55.0, None), (*ids, 220052, d + "00:20:00", None, 400.0, None), (*ids, 220052, d + "00:30:00", None, 20.0, 1), (*ids, 223761, d + "00:10:00", None, 100.4, None),
        (*ids, 220277, d + "00:40:00", None, 95.0, None), (*ids, 223835, d + "00:05:00", None, 0.5, None), (*ids, 720, d + "00:00:30", "Assist", None, None), (*ids, 720, d + "03:00:00", "Assist", None, None), (*ids, 640, d + "03:30:00", "Extubated", None, None),
        (*ids, 454, d + "00:15:00", None, 5.0, None), (*ids, 184, d + "00:15:00", None, 3.0, None), (*ids, 723, d + "00:15:00", None, 4.0, None), (*ids, 762, d + "00:01:00", None, 80.0, None),
    ]
    lab = [(1, 10, 50821, d + "00:50:00", None, 60.0), (1, 10, 50800, d + "00:50:00", "ART", None), (1, 10, 50816, d + "00:50:00", None, 10.0), (1, 10, 51265, d + "00:45:00", None, 40.0), (1, 10, 50912, d + "00:45:00", None, 200.0), (1, 10, 50885, d + "01:30:00", None, 7.0)]
    cohort = [(10, 100, 0, d + "00:00:00", "2100-01-03 05:00:00", "2100-01-05 00:00:00"), (11, 101, 1, d + "00:00:00", "2100-01-03 05:00:00", None)]
    chart_shape = "subject_id int, hadm_id int, icustay_id int, itemid int, charttime string, value string, valuenum double, error int"
    return {
        "stays": made(spark, [ids, (2, 11, 101)], "subject_id int, hadm_id int, icustay_id int"),
        "cohort": t(made(spark, cohort, "hadm_id int, icustay_id int, excluded int, intime string, outtime string, suspected_infection_time_poe string"), "intime", "outtime", "suspected_infection_time_poe"),
        "chart": t(made(spark, chart, chart_shape), "charttime"),
        "labs": t(made(spark, lab, "subject_id int, hadm_id int, itemid int, charttime string, value string, valuenum double"), "charttime"),
        "outputs": t(made(spark, [(*ids, 226559, d + "01:10:00", 300.0), (*ids, 227488, d + "01:10:00", 150.0)], "subject_id int, hadm_id int, icustay_id int, itemid int, charttime string, value double"), "charttime"),
        "inputs_cv": t(made(spark, [(100, 30047, d + "00:20:00", 16.0)], "icustay_id int, itemid int, charttime string, rate double"), "charttime"),
        "inputs_mv": t(made(spark, [(100, 221662, d + "02:30:00", 6.0, "Finished"), (100, 221662, d + "02:40:00", 60.0, "Rewritten")], "icustay_id int, itemid int, starttime string, rate double, statusdescription string"), "starttime"),
        "procedures": t(made(spark, [(10, 100, 225468, d + "04:00:00")], "hadm_id int, icustay_id int, itemid int, starttime string"), "starttime"),
        "notes": t(made(spark, [(1, 1, 10, "2100-01-02", "Echo", "Indication: x\nHeight: (in) 70\nWeight (lb): [**1**]\nBP (mm Hg): 120/80\nDate/Time: [**2100-1-2**] at 10:30\n")], "row_id int, subject_id int, hadm_id int, chartdate string, category string, text string"), "chartdate"),
    }


def test_views(tables):
    s, c, ch = tables["stays"], tables["cohort"], tables["chart"]
    v = {r.charttime.minute: r for r in V.vitals(s, c, ch).collect()}
    assert v[10].MeanBP_Min == 55 and abs(v[10].TempC_Mean - 38) < 1e-9 and v[20].MeanBP_Min is None and 30 not in v
    e = V.echo(tables["notes"], c).first()
    assert (e.Height, e.Weight, e.BPSys, e.BPDias, e.Indication, e.charttime.hour) == (70.0, None, 120.0, 80.0, "x", 10)
    assert V.urine_output(s, c, tables["outputs"]).first().UrineOutput == 150.0
    vents = V.vent_durations(V.vent_settings(ch, tables["procedures"], c)).collect()
    assert [(r.ventnum, r.starttime.second, r.endtime.hour) for r in vents] == [(1, 30, 3)]
    a = V.arterial(V.blood_gas(s, c, tables["labs"]), ch).first()
    assert (a.SPO2, a.FIO2_CHART, a.FIO2, a.PaO2FiO2, a.SPECIMEN_PRED) == (95.0, 50.0, None, 120.0, "ART")
    assert V.lowest_coma(V.coma_scores(ch)).first().gcs == 12


def test_hourly_scores_and_onset(tables):
    got = V.hourly_scores(tables, entire_stay=True).orderBy("hr").collect()
    assert [r.hr for r in got] == [0, 1, 2, 3, 4]
    assert (got[0].respiration, got[0].coagulation, got[0].liver, got[0].cardiovascular, got[0].cns, got[0].renal, got[0].sofa) == (3, 3, None, 4, 2, None, 12)
    assert (got[1].liver, got[1].renal, got[1].cardiovascular) == (3, 4, None) and got[2].cardiovascular == 3
    assert V.hourly_scores(tables).count() == 72
    assert V.with_onset(tables["cohort"], V.hourly_scores(tables)).count() == 2


def test_the_tables_of_scores_and_onsets(spark, tables, tmp_path):
    """One row a stay and hour, and one a stay whose score rises, written as a whole."""
    cohort = tables["cohort"].withColumn("subject_id", F.lit(1))
    scores = V.hourly_scores(tables, entire_stay=True)
    made = V.materialise({"hourly": V.hourly_table(cohort, scores), "onsets": V.onsets(cohort, scores)}, str(tmp_path))
    rows = made["hourly"].orderBy("calculation_time").collect()
    assert [(r.calculation_time - r.intime).total_seconds() / 3600 for r in rows] == [0, 1, 2, 3, 4]
    assert all((r.window_start_time, r.window_end_time) == (r.intime, r.outtime) and r.hadm_id == 10 for r in rows)
    by_hand = {r.hr: r.sofa for r in scores.collect()}
    assert [r.sofa_score for r in rows] == [by_hand[i] for i in range(5)]
    up = [i for i in range(5) if by_hand[i] - by_hand[0] >= 2]
    assert [r.onsettime_sofa_score for r in spark.table("onsets").collect()] == [by_hand[i] for i in up[:1]]
    rising = scores.withColumn("sofa", F.col("hr") + F.col("sofa") - F.col("sofa"))
    first = V.onsets(cohort, rising).collect()
    assert [(r.initial_sofa_score, r.onsettime_sofa_score, r.sepsis_onset_time.hour) for r in first] == [(0, 2, 2)]
