"""End-to-end runs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durable import durable
from ..operators import evaluation, frame, models, prepare, scoring, selection
from ..operators.extract import FEATURE_CLASSES, STANDARD_FILTERS, extract_features
from ..operators.first_order import first_order
from ..operators.lasso import lasso_tables
from ..session import tune
from ..sources import checks
from ..sources.tables import materialize, with_ord, write_per_modality, write_table
from . import fixtures as fx

# Classifier numbers of the report.
CLASSIFIERS = {
    0: "logistic_regression",
    1: "gaussian_process",
    2: "svm",
    3: "sgd",
    4: "k_nearest_neighbors",
    5: "decision_tree",
    6: "random_forest",
    7: "adaboost",
    8: "naive_bayes",
    9: "quadratic_discriminant_analysis",
    10: "gradient_boosting",
    11: "neural_network",
}


@dataclass
class RunConfig:
    """Settings of a run; ``methods`` is the selection chain as (selector, options).

    ``balance`` is how classes are evened out for training: ``"weights"`` (balanced class weights), ``"smote"`` (synthetic rows of the
    smaller class) or None.
    """

    modalities: Sequence[str] = ()
    classes: Sequence[str] = tuple(FEATURE_CLASSES)
    filters: Sequence[str] = tuple(STANDARD_FILTERS)
    binwidth: float | None = None
    scaling: int = 0
    variance_threshold: float = 0.01
    test_size: float = 0.3
    seed: int = 42
    methods: Sequence[tuple[str, dict]] = (("anova", {"p_feature": 0.2}), ("lasso", {}))
    classifiers: Sequence[int] = (0, 8)
    cutoff_from: str = "test"
    scale_on_train: bool = False
    classifier_options: dict[int, dict] = field(default_factory=dict)
    balance: str | None = None
    smote_k: int = 5


def balanced_rows(arrays: DataFrame, balance: str | None, smote_k: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training rows as (arrays, vectors): as they are, with class weights, or with synthetic rows of the smaller class.

    Weights are read by the linear, tree and boosting learners; the others train without them.
    """
    if balance not in (None, "weights", "smote"):
        raise ValueError(f"unknown balance {balance!r}")
    if balance == "smote":
        arrays = durable(models.smote(arrays, smote_k, seed=seed))
    vectors = arrays.select("case_id", "label", array_to_vector("values").alias("features"))
    return arrays, frame.with_class_weights(vectors) if balance == "weights" else vectors


def _long_again(arrays: DataFrame, feat: DataFrame) -> DataFrame:
    """(case_id, label, feature, ord, value) of array rows; ``feat`` names the features in order."""
    names = feat.select("feature", "ord").distinct().orderBy("ord").collect()
    names = feat.sparkSession.createDataFrame([(i, r["feature"], r["ord"]) for i, r in enumerate(names)], "pos int, feature string, ord int")
    cells = arrays.select("case_id", "label", F.posexplode("values").alias("pos", "value"))
    return cells.join(names, "pos").select("case_id", "label", "feature", "ord", "value")


def classify(
    train: DataFrame, test: DataFrame, classifiers: Sequence[int], options: dict[int, dict] | None = None, balance: str | None = None,
    smote_k: int = 5, seed: int = 42, path: str | None = None,
) -> DataFrame:
    """Long predictions (case_id, label, method, prob, split) of the numbered classifiers on the cases of both splits.

    With ``path`` every classifier's predictions are a stage of their own there: another classifier, or other options of one, trains
    that one alone.
    """
    options = options or {}
    data = {"train": train, "test": test}
    arrays = {s: frame.to_arrays(df) for s, df in data.items()}
    vectors = {s: frame.to_vectors(df).persist() for s, df in data.items()}
    fit_arrays, fit_vectors = balanced_rows(arrays["train"], balance, smote_k, seed)
    fit_vectors = fit_vectors.persist()
    fitters = {
        0: models.logistic_cv,
        1: models.gaussian_process,
        2: lambda rows, **o: (models.svm_search if "kernels" in o else models.svm_linear)(rows, **o),
        3: models.linear_elasticnet,
        5: models.decision_tree,
        6: models.random_forest,
        7: models.adaboost,
    }
    fitters |= {10: models.gbt, 11: models.mlp}

    def predicted(number: int) -> DataFrame:
        chosen = options.get(number, {})
        if number in fitters:
            score = fitters[number](fit_vectors, **chosen)
            scored = {s: score(vectors[s]) for s in data}
        elif number == 4:
            if "k" in chosen:
                score = lambda df: models.knn_predict(fit_arrays, df, **chosen)
            else:
                score = models.knn_tuned(fit_arrays, **chosen)
            scored = {s: score(arrays[s]) for s in data}
        elif number == 8:
            rows = _long_again(fit_arrays, train) if balance == "smote" else train
            scored = {s: models.gaussian_nb(rows, data[s], **chosen) for s in data}
        else:
            score = models.qda(fit_arrays, **chosen)
            scored = {s: score(arrays[s]) for s in data}
        both = [df.select("case_id", "label", "prob", F.lit(s).alias("split")) for s, df in scored.items()]
        return both[0].unionByName(both[1]).select("case_id", "label", F.lit(CLASSIFIERS[number]).alias("method"), "prob", "split")

    unknown = [n for n in classifiers if n not in CLASSIFIERS]
    if unknown:
        raise ValueError(f"unknown classifier {unknown[0]}")
    out = None
    for number in classifiers:
        if path is None:
            part = predicted(number)
        else:
            depends = [train, test, number, options.get(number, {}), balance, smote_k, seed]
            part = materialize(train.sparkSession, lambda n=number: predicted(n), f"{path}/predictions/{CLASSIFIERS[number]}", depends)
        out = part if out is None else out.unionByName(part)
    if path is not None:
        for held in (*vectors.values(), fit_vectors):
            held.unpersist()
    return out


def lasso_reports(train: DataFrame, support: DataFrame, methods: Sequence[tuple[str, dict]]) -> dict[str, DataFrame]:
    """Error curve and coefficients of every lasso step of a selection chain, on the features that reached it."""
    out = {}
    for step, (method, chosen) in enumerate(methods, start=1):
        if method == "lasso":
            reached = selection.keep_features(train, support.filter(F.col("step") == step))
            out[f"lasso_errors_{step}"], out[f"lasso_coefficients_{step}"] = lasso_tables(reached, **chosen)
    return out


def report(pred: DataFrame, cutoff_from: str = "test") -> dict[str, DataFrame]:
    """All report tables; the cutoff is learned on one split and used for both."""
    ranking = evaluation.rank_methods(pred.filter("split = 'test'").drop("split"))
    best = ranking.filter("rank = 1").select("method")
    chosen = pred.join(best, "method", "left_semi").select("method", "split", "label", "prob")
    cutoff = evaluation.youden_cutoff(chosen.filter(F.col("split") == cutoff_from).drop("split"))
    return {
        "roc": evaluation.roc_curve(pred),
        "ranking": ranking,
        "cutoff": cutoff,
        "confusion": evaluation.confusion_matrix(chosen, cutoff),
        "metrics": evaluation.metrics_report(chosen, cutoff),
        "calibration": evaluation.calibration_curve(chosen),
        "decision": evaluation.decision_curve(chosen),
        "precision_recall": evaluation.pr_curve(pred),
    }


def run_from_features(feat: DataFrame, config: RunConfig, path: str) -> dict[str, DataFrame]:
    """Split, select, classify and report a long feature table; stages are kept under ``path`` and reused."""
    spark = feat.sparkSession
    cases = feat.select("case_id", "label").distinct()
    split = materialize(
        spark,
        lambda: frame.stratified_split(cases, config.test_size, config.seed),
        f"{path}/split",
        [cases, config.test_size, config.seed],
    )

    def prepared() -> DataFrame:
        if not config.scale_on_train:
            return frame.preprocess(feat, (), config.variance_threshold, config.scaling)
        stats = frame.fit_scaler(feat.join(split.filter("split = 'train'"), "case_id", "left_semi"))
        return frame.apply_scaler(feat, stats.filter(F.col("std") * F.col("std") > config.variance_threshold), config.scaling)

    scaled_by = [config.scale_on_train, config.variance_threshold, config.scaling]
    clean = materialize(spark, prepared, f"{path}/preprocessed", [feat, split, scaled_by])
    parts = {
        s: clean.join(split.filter(F.col("split") == s), "case_id", "left_semi") for s in ("train", "test")
    }
    support = materialize(
        spark, lambda: selection.run_selection(parts["train"], config.methods), f"{path}/support", [parts["train"], config.methods]
    )
    kept = {
        s: materialize(spark, lambda df=df: selection.apply_support(df, support), f"{path}/selected_{s}", [df, support])
        for s, df in parts.items()
    }
    pred = classify(
        kept["train"], kept["test"], config.classifiers, config.classifier_options, config.balance, config.smote_k, config.seed, path
    )
    tables = report(pred, config.cutoff_from)
    tables["support"] = support
    tables["predictions"] = pred
    tables |= lasso_reports(parts["train"], support, config.methods)
    forest = support.filter("method = 'random_forest'")
    if any(method == "random_forest" for method, _ in config.methods):
        tables["forest_importance"] = forest.select("step", "feature", "score", "keep")
    stages = [(name, df.select("feature").distinct().count()) for name, df in (("extracted", feat), ("after_variance", clean))]
    settings = {k: v for k, v in asdict(config).items() if k not in ("classifiers", "classifier_options")}
    settings["classifiers"] = [CLASSIFIERS[n] for n in config.classifiers]
    settings["classifier_options"] = {CLASSIFIERS[n]: o for n, o in config.classifier_options.items()}
    tables["summary"] = evaluation.run_summary(
        {
            "location": spark.createDataFrame([("folder", path)], "key string, path string"),
            "settings": spark.createDataFrame([(k, str(v)) for k, v in settings.items()], "key string, setting string"),
            "classes": frame.class_distribution(split),
            "stages": spark.createDataFrame(stages, "stage string, n_features long"),
            "features": selection.survivors(support).select("method", "step", "n_kept"),
            "best": tables["ranking"].filter("rank = 1").select("method", "auc"),
            "cutoff": tables["cutoff"],
        }
    )
    reports = [n for n in tables if n.startswith(("lasso_", "forest_"))]
    for name in ("metrics", "summary", "ranking", "confusion", "calibration", "decision", *reports):
        write_table(tables[name], f"{path}/{name}", "csv")
    for s in ("train", "test"):
        write_table(pred.filter(F.col("split") == s).drop("split"), f"{path}/predictions_{s}", "csv")
    return tables


def _same_geometry(vox: DataFrame, mask_dims: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Voxels of the cases whose images all have the size of their masks, and the odd images; all voxels without ``mask_dims``."""
    if mask_dims is None:
        return vox, None
    images = checks.image_dims(vox)
    whole, odd = checks.matching_geometry(images, mask_dims.join(images, ["case_id", "modality"], "left_semi"))
    # Written, as a few rows per case: every reader of the voxels would work the sizes out again.
    return vox.join(durable(whole), "case_id", "left_semi"), durable(odd)


def run_training(
    cohort: DataFrame, vox: DataFrame, volumes: DataFrame, inventory: DataFrame, config: RunConfig, path: str,
    mask_dims: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Check completeness, extract, and continue from the features.

    With ``mask_dims`` (case_id, modality, n_z, n_y, n_x) only cases whose images have the size of their masks go on; the odd images are
    the table ``geometry`` of the result.
    """
    spark = cohort.sparkSession
    missing = checks.missing_pairs(cohort, config.modalities, inventory)
    first = missing.first()
    if first is not None:
        raise ValueError(f"case {first['case_id']} has no {first['kind']} of modality {first['modality']}")
    wanted = vox.filter(F.col("modality").isin(list(config.modalities))).join(cohort, "case_id", "left_semi")
    wanted, odd = _same_geometry(wanted, mask_dims)

    def extracted() -> DataFrame:
        if config.binwidth is not None:
            return extract_features(wanted, volumes, config.classes, config.filters, config.binwidth)
        widths = prepare.auto_binwidth(wanted, seed=config.seed).collect()
        out = None
        for row in widths:
            part = extract_features(
                wanted.filter(F.col("modality") == row["modality"]), volumes, config.classes, config.filters, row["binwidth"]
            )
            out = part if out is None else out.unionByName(part)
        return out

    settings = [config.classes, config.filters, config.binwidth, config.seed, config.modalities, mask_dims is not None]
    features = materialize(spark, extracted, f"{path}/features", [wanted, volumes, settings])
    labelled = with_ord(features).join(cohort, "case_id")
    tables = run_from_features(labelled, config, path)
    if odd is not None:
        tables["geometry"] = odd
        write_table(odd, f"{path}/geometry", "csv")
    return tables


def prepare_ct(
    vox: DataFrame, volumes: DataFrame, clinical: DataFrame, spacing: Sequence[float], expected: int | None = None,
    mask_dims: DataFrame | None = None, records: DataFrame | None = None, **extract,
) -> tuple[DataFrame, DataFrame]:
    """Regridded CT, clipped (bin width 10) and windowed (bin width 5): (features with clinical columns, count misses).

    With ``mask_dims`` cases whose image and mask differ in size are left out. With ``records`` (case_id, record) the clinical fields
    come from the JSON records, and from ``clinical`` where a record or field is missing.
    """
    vox, _ = _same_geometry(vox, mask_dims)
    if records is not None:
        clinical = checks.clinical_lookup(clinical.select("case_id"), records, clinical)
    grid = durable(prepare.regrid_nearest(prepare.binarize_mask(vox), volumes, spacing, "origin"))
    target = volumes.select(
        "case_id", "modality", *[F.lit(float(s)).alias(f"spacing_{a}") for a, s in zip(("z", "y", "x"), spacing)]
    )
    clipped = extract_features(prepare.clip_percentile(grid), target, binwidth=10, **extract)
    windowed = extract_features(prepare.change_window(grid), target, binwidth=5, **extract)
    # Features are read twice, by the count check and by the caller; they are worked out once.
    both = durable(clipped.withColumn("image", F.lit("original")).unionByName(windowed.withColumn("image", F.lit("windowed"))))
    misses = checks.feature_count_check(both, expected or 0, ("case_id", "image"))
    return both.join(clinical, "case_id", "left"), misses if expected is not None else misses.limit(0)


def prepare_mri(
    vox: DataFrame, volumes: DataFrame, spacing: Sequence[float], binwidth: float = 50, expected: int | None = None,
    path: str | None = None, **extract,
) -> DataFrame:
    """Clipped and regridded MRI features per modality.

    ``expected`` is the number of features that every case and modality must have, else the run stops. With ``path`` the features are
    written there as CSV, one folder per modality, and read by the caller from what was worked out once.
    """
    grid = prepare.regrid_nearest(prepare.clip_percentile(vox), volumes, spacing, "center")
    target = volumes.select(
        "case_id", "modality", *[F.lit(float(s)).alias(f"spacing_{a}") for a, s in zip(("z", "y", "x"), spacing)]
    )
    out = extract_features(grid, target, binwidth=binwidth, **extract)
    if expected is None and path is None:
        return out
    # Feature names end with the modality; of modalities that end alike the longest counts.
    names = sorted((r["modality"] for r in volumes.select("modality").distinct().collect()), key=len, reverse=True)
    ending = F.coalesce(*[F.when(F.endswith("feature", F.lit(f"_{m}")), F.lit(m)) for m in names])
    out = durable(out.withColumn("modality", ending))
    if expected is not None:
        odd = checks.feature_count_check(out, expected, ("case_id", "modality")).first()
        if odd is not None:
            raise ValueError(f"case {odd['case_id']} has {odd['n_features']} features of modality {odd['modality']}, not {expected}")
    if path is not None:
        write_per_modality(out, path)
    return out.drop("modality")


def best_first_order(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Voxels to the k best first-order features of the train rows."""
    tune(spark)
    vox, cohort = fx.voxels(spark, sf_dir), fx.cohort(spark, sf_dir)
    wide = frame.combine_modalities(first_order(vox, 0.05, fx.volumes(spark, sf_dir)))
    labelled = with_ord(wide).join(frame.stratified_split(cohort, 0.3), "case_id").filter("split = 'train'")
    return scoring.select_k_best(scoring.f_scores(frame.preprocess(labelled, variance_threshold=1e-6)), k)
