"""Call-for-call entry points for users of the single-machine application.

Each function takes and returns Spark DataFrames (or a small result object)
where the original took and returned in-memory frames; single-case helpers
take a table of cases instead of one case. Nothing here adds logic: it maps
names onto the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casekit import config as C
from casekit.operators import cohort as K
from casekit.operators import evaluate as E
from casekit.operators import prepare as P
from casekit.operators import scoring as S
from casekit.plans import training as TR
from casekit.sources import delimited as DL


# ---------------------------------------------------------------- ingest + preparation
def load_data(spark: SparkSession, directory: str, files: dict[str, str] | None = None) -> dict[str, DataFrame]:
    files = files or {"demo": "DEMO.txt", "drug": "DRUG.txt", "outc": "OUTC.txt", "reac": "REAC.txt"}
    return DL.load_sources(spark, directory, files)


def preprocess_data(demo: DataFrame, drug: DataFrame, outc: DataFrame, reac: DataFrame | None = None) -> DataFrame:
    return P.case_table(demo, drug, outc, reac)


resolve_column = P.resolve_column
validate_upload_data = P.validate_upload
prepare_external_features = P.prepare_external


def prepare_uploaded_analysis_data(df: DataFrame, id_col: str = "primaryid") -> DataFrame:
    """Labelled upload -> case schema; an invalid upload raises with the validation message."""
    verdict = P.validate_upload(df).first()
    if not verdict["is_valid"]:
        raise ValueError(verdict["message"])
    return P.prepare_labelled(df, id_col)


build_feature_frame = P.build_feature_frame


# ---------------------------------------------------------------- cohort analytics
def build_data_quality_report(*, demo: DataFrame, drug: DataFrame, outc: DataFrame, reac: DataFrame,
                              processed: DataFrame) -> dict[str, DataFrame]:
    src = {"demo": demo, "drug": drug, "outc": outc, "reac": reac}
    return {"source_rows": K.source_rows(src), "missing_values": K.missing_values(src),
            "feature_summary": K.feature_summary(processed), "retention": K.retention(demo, processed)}


def build_uploaded_quality_report(processed: DataFrame) -> dict[str, DataFrame]:
    return {"missing_values": K.upload_quality(processed), "feature_summary": K.feature_summary(processed)}


calculate_risk_deltas = K.risk_deltas
build_final_stats = K.final_stats
build_top_risk_segments = K.top_risk_segments
generate_clinical_insights = K.clinical_insights
key_metrics = K.key_metrics
executive_summary = K.executive_summary


def cohort_filter(cases: DataFrame, age_min: float | None = None, age_max: float | None = None) -> DataFrame:
    return P.cohort_filter(cases, age_min, age_max)


# ---------------------------------------------------------------- models
def run_ml_pipeline(cases: DataFrame, max_rows: int | None = None) -> TR.TrainingResult:
    """Full training pipeline (``max_rows=70000`` reproduces the original cap)."""
    return TR.run_training(cases, max_rows=max_rows)


evaluate_thresholds = E.threshold_sweep
build_model_comparison_summary = E.model_digest


# ---------------------------------------------------------------- scoring and explanation
def probability_to_risk(df: DataFrame, prob_col: str = "probability") -> DataFrame:
    return S.with_risk_level(df, prob_col)


action_from_risk = S.action_for
confidence_from_probability = S.confidence
build_patient_profile = S.patient_profile
build_ai_interpretation = S.interpretation
create_ai_story_flow = S.story_flow
get_ai_insight_text = S.insight_text
format_ai_decision_text = S.decision_text
build_risk_segmentation = S.risk_segmentation


def explain_prediction(cases: DataFrame, risk_col: str = "risk_level", importance_df: DataFrame | None = None,
                       top_n: int = C.EXPLAIN_TOP_N) -> DataFrame:
    return S.explain(cases, risk_col, importance_df, top_n)


def predict_cases(cases: DataFrame, result: TR.TrainingResult, importance_df: DataFrame | None = None,
                  decision_threshold: float | None = None) -> DataFrame:
    """Score a table of cases with a trained result (the single-case form, for many cases)."""
    from casekit.operators import models as M

    model, scaler = result.best_model, result.scaler

    def scorer(df: DataFrame) -> DataFrame:
        return M.positive_probability(model, scaler.transform(df), df.columns).withColumnRenamed("p", "probability")
    t = result.best_threshold if decision_threshold is None else decision_threshold
    feats = P.prepare_external(cases)
    return S.score_cases(feats, scorer, t, importance_df, label_threshold=0.5)


def what_if(cases: DataFrame, scenarios: DataFrame, result: TR.TrainingResult | None = None) -> DataFrame:
    if result is None:
        return S.what_if(cases, scenarios)
    from casekit.operators import models as M

    def scorer(df: DataFrame) -> DataFrame:
        return M.positive_probability(result.best_model, result.scaler.transform(df), df.columns) \
            .withColumnRenamed("p", "probability")
    return S.what_if(cases, scenarios, scorer)
