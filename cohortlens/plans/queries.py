"""Registry of queries over the driver tables: name -> function of (session, folder)."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durable import settled
from ..operators import evaluation, extract, filters, frame, models, prepare, scoring, selection, shape, texture
from ..operators.first_order import first_order
from ..session import tune
from ..sources import checks
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

BINWIDTH = 0.05
SPACING = (1.0, 0.6, 0.6)
VARIANCE = 0.0156
VOXEL = ["case_id", "modality", "z", "y", "x"]


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark)
        return fn(spark, sf_dir)

    REGISTRY[fn.__name__] = run
    return run


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round floats, so that the order of additions cannot show; the nudge keeps exact fractions off a tie."""
    return df.select(*[F.round(F.col(c) + 1e-9, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return prepare.discretize(fx.voxels(spark, d), BINWIDTH)


# ------------------------------------------------------------------------------------------- sources and checks


@query
def missing_pairs(spark, d):
    return checks.missing_pairs(fx.cohort(spark, d), ["A", "B"], fx.inventory(spark, d))


@query
def clinical_lookup(spark, d):
    """Records are event properties, the fallback is the customer of the event."""
    events = fx.table(spark, d, "events").select(F.col("event_id").cast("string").alias("case_id"), "event_type", "user_id", "props")
    cases = events.select("case_id")
    record = F.concat(F.lit('{"Models":{"LabelDetailModel":{"table":{"t":'), "props", F.lit("}}}}"))
    records = events.filter(F.col("event_type") != "error").select("case_id", record.alias("record"))
    customers = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("age"))
    fallback = events.join(customers, "user_id").select("case_id", "age")
    return checks.clinical_lookup(cases, records, fallback, fields={"age": "k"})


@query
def geometry_check(spark, d):
    """Image size against the size of the box that holds the mask."""
    vox = fx.voxels(spark, d)
    return checks.geometry_check(checks.image_dims(vox), checks.image_dims(vox.filter("mask = 1")))


@query
def geometry_check_mixed(spark, d):
    """Masks of odd cases fill a corner only: both answers occur."""
    vox = fx.corner_voxels(spark, d, odd_only=True)
    return checks.geometry_check(checks.image_dims(vox), checks.image_dims(vox.filter("mask = 1")))


@query
def feature_count_check(spark, d):
    """Features above zero per case, against an expected number."""
    return checks.feature_count_check(fx.features(spark, d).filter("value > 0"), 33)


# ------------------------------------------------------------------------------------------- voxel preparation


@query
def binarize_mask(spark, d):
    vox = fx.voxels(spark, d)
    graded = vox.withColumn("mask", F.col("mask") + (F.col("value") > 0).cast("int"))
    return prepare.binarize_mask(graded, 1).select(*VOXEL, "mask")


@query
def change_window(spark, d):
    scaled = fx.voxels(spark, d).withColumn("value", F.col("value") * 1000)
    return rounded(prepare.change_window(scaled).select(*VOXEL, "value"), "value")


@query
def clip_percentile(spark, d):
    return rounded(prepare.clip_percentile(fx.voxels(spark, d)).select(*VOXEL, "value"), "value")


@query
def crop_to_roi(spark, d):
    return prepare.crop_to_roi(fx.voxels(spark, d)).select(*VOXEL, "value")


@query
def crop_to_roi_corner(spark, d):
    """A region in one corner: most voxels are cut off."""
    return prepare.crop_to_roi(fx.corner_voxels(spark, d)).select(*VOXEL, "value")


@query
def normalize_image(spark, d):
    return rounded(prepare.normalize_image(fx.voxels(spark, d)).select(*VOXEL, "value"), "value")


@query
def auto_binwidth(spark, d):
    return rounded(prepare.auto_binwidth(fx.voxels(spark, d)), "binwidth")


@query
def discretize(spark, d):
    return _levels(spark, d).filter("level is not null").select(*VOXEL, "level")


@query
def median_spacing(spark, d):
    return rounded(prepare.median_spacing(fx.volumes(spark, d)), "spacing")


@query
def regrid_origin(spark, d):
    return prepare.regrid_nearest(fx.voxels(spark, d), fx.volumes(spark, d), SPACING, "origin", -1.0)


@query
def regrid_center(spark, d):
    return prepare.regrid_nearest(fx.voxels(spark, d), fx.volumes(spark, d), SPACING, "center")


# ------------------------------------------------------------------------------------------- filters


def _filtered(df: DataFrame) -> DataFrame:
    return rounded(df.select(*VOXEL, "value", "filter"), "value")


@query
def filter_original(spark, d):
    return _filtered(filters.apply_filter(fx.voxels(spark, d), "original"))


@query
def filter_square(spark, d):
    return _filtered(filters.apply_filter(fx.voxels(spark, d), "square"))


@query
def filter_square_root(spark, d):
    return _filtered(filters.apply_filter(fx.voxels(spark, d), "square_root"))


@query
def filter_logarithm(spark, d):
    return _filtered(filters.apply_filter(fx.voxels(spark, d), "logarithm"))


@query
def filter_exponential(spark, d):
    return _filtered(filters.apply_filter(fx.voxels(spark, d), "exponential"))


@query
def filter_gradient(spark, d):
    return _filtered(filters.apply_filter(fx.voxels(spark, d), "gradient", fx.volumes(spark, d)))


@query
def filter_log(spark, d):
    return _filtered(filters.apply_filter(fx.voxels(spark, d), "log_1", fx.volumes(spark, d)))


@query
def filter_wavelet(spark, d):
    return _filtered(filters.apply_filter(fx.voxels(spark, d), "wavelet"))


@query
def filter_lbp_2d(spark, d):
    return _filtered(filters.apply_filter(fx.voxels(spark, d), "lbp-2D"))


# ------------------------------------------------------------------------------------------- features


@query
def first_order_features(spark, d):
    return rounded(first_order(fx.voxels(spark, d), BINWIDTH, fx.volumes(spark, d)), "value")


@query
def shape3d(spark, d):
    return rounded(shape.shape3d(fx.voxels(spark, d), fx.volumes(spark, d)), "value")


@query
def shape2d(spark, d):
    return rounded(shape.shape2d(fx.voxels(spark, d), fx.volumes(spark, d)), "value")


@query
def glcm_matrix(spark, d):
    return texture.glcm_matrix(texture.level_neighbours(_levels(spark, d)))


@query
def glcm_cut(spark, d):
    """Slabs of two slices and bands of two lines: pairs cross the cuts."""
    levels = _levels(spark, d)
    return texture.glcm_matrix(texture.level_neighbours(levels, texture.level_lines(levels, depth=2, rows=2)))


@query
def glcm_features(spark, d):
    """All 24 features, MCC among them."""
    matrix = texture.glcm_matrix(texture.level_neighbours(_levels(spark, d)))
    return rounded(texture.glcm_features(matrix), "value")


@query
def glcm_mcc(spark, d):
    matrix = texture.glcm_matrix(texture.level_neighbours(_levels(spark, d)))
    return rounded(texture.mean_over_directions(texture.glcm_mcc(matrix), ["case_id", "modality"]), "value")


@query
def glrlm_matrix(spark, d):
    return texture.glrlm_matrix(texture.level_neighbours(_levels(spark, d)))


@query
def glrlm_features(spark, d):
    levels = _levels(spark, d)
    matrix = texture.glrlm_matrix(texture.level_neighbours(levels))
    return rounded(texture.glrlm_features(matrix, texture.roi_size(levels)), "value")


@query
def glszm_matrix(spark, d):
    return texture.glszm_matrix(_levels(spark, d))


@query
def glszm_cut(spark, d):
    """Slabs of two slices: zones are merged across the cuts."""
    return texture.glszm_matrix(_levels(spark, d), depth=2)


@query
def glszm_features(spark, d):
    levels = _levels(spark, d)
    return rounded(texture.glszm_features(texture.glszm_matrix(levels), texture.roi_size(levels)), "value")


@query
def ngtdm_features(spark, d):
    matrix = texture.ngtdm_matrix(texture.level_neighbours(_levels(spark, d)))
    return rounded(texture.ngtdm_features(matrix), "value")


@query
def gldm_matrix(spark, d):
    return texture.gldm_matrix(texture.level_neighbours(_levels(spark, d)))


@query
def gldm_features(spark, d):
    matrix = texture.gldm_matrix(texture.level_neighbours(_levels(spark, d)))
    return rounded(texture.gldm_features(matrix), "value")


@query
def extract_features(spark, d):
    """All classes on the original and squared images of both modalities (everything but MCC has an SQL twin)."""
    return rounded(
        extract.extract_features(
            fx.voxels(spark, d), fx.volumes(spark, d), filters=["original", "square"], binwidth=0.5, mcc=False
        ),
        "value",
    )


# ------------------------------------------------------------------------------------------- feature frames


def _feat(spark, d):
    return fx.features(spark, d)


def _value(df: DataFrame) -> DataFrame:
    return rounded(df.select("case_id", "feature", "value"), "value")


@query
def exclude_low_variance(spark, d):
    return _value(frame.exclude_low_variance(_feat(spark, d), VARIANCE))


@query
def standardize(spark, d):
    return _value(frame.standardize(_feat(spark, d)))


@query
def min_max(spark, d):
    return _value(frame.min_max(_feat(spark, d)))


@query
def preprocess(spark, d):
    return _value(frame.preprocess(_feat(spark, d), variance_threshold=VARIANCE))


def _split_features(spark, d, method: int | None = 0):
    """Train and test long features: a 30 % stratified split, variance filter and scaling fitted on train."""
    split = frame.stratified_split(fx.cohort(spark, d), 0.3).persist()
    feat = _feat(spark, d).join(split.select("case_id", "split"), "case_id")
    train, test = (feat.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    if method is None:
        return train, test
    stats = frame.fit_scaler(train).filter("std * std > 0.01")
    return tuple(frame.apply_scaler(part, stats, method).persist() for part in (train, test))


@query
def apply_scaler(spark, d):
    return _value(_split_features(spark, d, 1)[1])


@query
def stratified_split(spark, d):
    return frame.stratified_split(fx.wide_rows(spark, d), 0.3).select("case_id", "split")


@query
def split_by_list(spark, d):
    listed = frame.stratified_split(fx.cohort(spark, d), 0.3)
    return frame.split_by_list(fx.cohort(spark, d), listed)


@query
def class_distribution(spark, d):
    return frame.class_distribution(frame.stratified_split(fx.wide_rows(spark, d), 0.3))


@query
def shuffle_rows(spark, d):
    return frame.shuffle_rows(fx.wide_rows(spark, d), 7).select("case_id", "label", "v1")


@query
def class_weights(spark, d):
    return rounded(frame.class_weights(fx.wide_rows(spark, d)), "weight")


@query
def stratified_folds(spark, d):
    return frame.stratified_folds(fx.wide_rows(spark, d), 10, 3)


@query
def combine_modalities(spark, d):
    first = first_order(fx.voxels(spark, d), BINWIDTH, fx.volumes(spark, d))
    return rounded(frame.combine_modalities(first), "value")


@query
def to_wide(spark, d):
    return frame.to_wide(_feat(spark, d), [f"f{i:02d}" for i in range(65)])


@query
def to_vectors(spark, d):
    """Vector form, read back by position."""
    from pyspark.ml.functions import vector_to_array

    vectors = frame.to_vectors(_feat(spark, d))
    return vectors.select("case_id", "label", F.posexplode(vector_to_array("features")).alias("ord", "value"))


@query
def smote(spark, d):
    few = fx.table(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("case_id"),
        (F.col("label") >= 7).cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("values"),
    )
    return models.smote(few)


# ------------------------------------------------------------------------------------------- scores and selection


@query
def chi2_scores(spark, d):
    return rounded(scoring.chi2_scores(_feat(spark, d)).select("feature", "score"), "score")


@query
def f_scores(spark, d):
    return rounded(scoring.f_scores(_feat(spark, d)).select("feature", "score"), "score")


@query
def select_k_best(spark, d):
    return scoring.select_k_best(scoring.f_scores(_feat(spark, d)), 10).select("feature", "rank")


@query
def mi_scores(spark, d):
    return rounded(scoring.mi_scores(_feat(spark, d)).select("feature", "score"), "score")


@query
def mrmr_select(spark, d):
    return rounded(selection.mrmr_ranking(_feat(spark, d), 5), "score")


@query
def mrmr_mixed_scale(spark, d):
    """Features of very different size: the ranking must not depend on it."""
    feat = _feat(spark, d).withColumn("value", F.col("value") * F.pow(F.lit(10.0), F.col("ord") % 19 - 9))
    return rounded(selection.mrmr_ranking(feat, 5), "score")


@query
def relief_weights(spark, d):
    return rounded(scoring.relief_weights(_feat(spark, d), 20).select("feature", "score"), "score")


@query
def relief_select(spark, d):
    return selection.relief_select(_feat(spark, d), 20, n_feature=10).select("feature", "keep")


@query
def correlation_matrix(spark, d):
    return rounded(selection.correlation_matrix(_feat(spark, d)), "r")


CHAIN = [("anova", {"n_feature": 30}), ("chi2", {"n_feature": 12})]


@query
def run_selection(spark, d):
    support = selection.run_selection(_split_features(spark, d)[0], CHAIN)
    return support.filter("keep").select("step", "method", "feature")


@query
def apply_support(spark, d):
    train, test = _split_features(spark, d)
    return _value(selection.apply_support(test, selection.run_selection(train, CHAIN)))


def _narrow(spark, d, k: int = 6):
    """Train and test rows of the k best features."""
    train, test = _split_features(spark, d)
    support = selection.run_selection(train, [("anova", {"n_feature": k})])
    return selection.keep_features(train, support.filter("keep")), selection.keep_features(test, support.filter("keep"))


@query
def rfe_cv(spark, d):
    return selection.rfe_cv(_narrow(spark, d)[0], step=2, folds=3).select("feature", "keep")


@query
def lasso_errors(spark, d):
    return selection.lasso_tables(_split_features(spark, d)[0], 10, 100)[0]


@query
def lasso_coefficients(spark, d):
    return selection.lasso_tables(_split_features(spark, d)[0], 10, 100)[1]


@query
def lasso_select(spark, d):
    return selection.lasso_select(_split_features(spark, d)[0]).select("feature", "score", "keep")


@query
def rf_importance(spark, d):
    return selection.rf_importance(_split_features(spark, d)[0])


@query
def rf_importance_select(spark, d):
    return selection.rf_importance_select(_split_features(spark, d)[0], n_feature=10).select("feature", "keep")


@query
def sequential_select_forward(spark, d):
    return selection.sequential_select(_split_features(spark, d)[0], "forward", "lasso", n_feature=4).select("feature", "keep")


@query
def sequential_select_backward(spark, d):
    return selection.sequential_select(_narrow(spark, d, 4)[0], "backward", "svm", 2, n_feature=3).select("feature", "keep")


@query
def boruta_select(spark, d):
    return selection.boruta_select(_split_features(spark, d)[0], max_iter=20, trees=50).select("feature", "score", "keep")


# ------------------------------------------------------------------------------------------- classifiers


def _vectors(spark, d, k: int = 6):
    return tuple(settled(frame.to_vectors(part)) for part in _narrow(spark, d, k))


def _prob(df: DataFrame) -> DataFrame:
    return rounded(df.select("case_id", "label", "prob"), "prob")


@query
def knn_predict(spark, d):
    train, test = map(frame.to_arrays, _split_features(spark, d))
    return _prob(models.knn_predict(train, test, 5, "distance"))


@query
def knn_search(spark, d):
    """Accuracy of every k and weighting over 3 x 10 folds of all features."""
    train = frame.to_arrays(_split_features(spark, d)[0])
    return rounded(models.knn_search(train), "score")


@query
def gaussian_nb(spark, d):
    return _prob(models.gaussian_nb(*_split_features(spark, d)))


@query
def qda(spark, d):
    train, test = map(frame.to_arrays, _narrow(spark, d))
    return _prob(models.qda(train)(test))


@query
def prediction_frame(spark, d):
    train, test = _split_features(spark, d)
    packed = frame.to_arrays(train), frame.to_arrays(test)
    scored = {"knn": models.knn_predict(*packed, 3), "naive_bayes": models.gaussian_nb(train, test)}
    return rounded(models.prediction_frame(scored), "knn", "naive_bayes")


def _all_vectors(spark, d):
    """Train and test rows with all features."""
    return tuple(frame.to_vectors(part) for part in _split_features(spark, d))


@query
def grid_search(spark, d):
    """Accuracy of the 50 elastic-net settings over 3 x 10 folds, all features."""
    return models.linear_search(_all_vectors(spark, d)[0], models.elasticnet_grid())[0]


@query
def logistic_cv(spark, d):
    train, test = _all_vectors(spark, d)
    return _prob(models.logistic_cv(train)(test))


@query
def svm_linear(spark, d):
    train, test = _all_vectors(spark, d)
    return _prob(models.svm_linear(train)(test))


@query
def svm_poly(spark, d):
    train, test = _vectors(spark, d, 4)
    return _prob(models.svm_poly(train)(test))


@query
def rff_transform(spark, d):
    from pyspark.ml.functions import vector_to_array

    lifted = models.rff_transform(frame.to_vectors(_feat(spark, d)), 0.5, 4)
    out = lifted.select("case_id", F.posexplode(vector_to_array("features")).alias("pos", "value"))
    return rounded(out, "value")


@query
def svm_rbf(spark, d):
    train, test = _all_vectors(spark, d)
    return _prob(models.svm_rbf(train, 0.2)(test))


@query
def svm_search(spark, d):
    """Best of the radial and the linear machine by 3 x 10 folds, all features."""
    train, test = _all_vectors(spark, d)
    return _prob(models.svm_search(train, ("rbf", "linear"))(test))


@query
def gaussian_process(spark, d):
    train, test = _all_vectors(spark, d)
    return _prob(models.gaussian_process(train, 0.2)(test))


@query
def linear_elasticnet(spark, d):
    train, test = _all_vectors(spark, d)
    return _prob(models.linear_elasticnet(train)(test))


@query
def decision_tree(spark, d):
    train, test = _vectors(spark, d)
    return _prob(models.decision_tree(train, ("gini",), (2,), 5)(test))


@query
def random_forest(spark, d):
    train, test = _vectors(spark, d)
    return _prob(models.random_forest(train, (20,), (5,), ("sqrt",), (2,), (True,))(test))


@query
def adaboost(spark, d):
    train, test = _vectors(spark, d)
    return _prob(models.adaboost(train, 4, 1.0, "SAMME.R")(test))


@query
def adaboost_samme(spark, d):
    train, test = _vectors(spark, d)
    return _prob(models.adaboost(train, 4, 1.0, "SAMME")(test))


@query
def gbt(spark, d):
    train, test = _vectors(spark, d)
    return _prob(models.gbt(train, 5)(test))


@query
def mlp(spark, d):
    train, test = _vectors(spark, d)
    return _prob(models.mlp(train, (4,), 30)(test))


@query
def random_search(spark, d):
    return models.random_search(*_all_vectors(spark, d))[0]


# ------------------------------------------------------------------------------------------- evaluation


@query
def roc_curve(spark, d):
    return rounded(evaluation.roc_curve(fx.predictions(spark, d)), "threshold", "fpr", "tpr")


@query
def auc(spark, d):
    return rounded(evaluation.auc(fx.predictions(spark, d)), "auc")


@query
def auc_rare_event(spark, d):
    """All scores below 0.001, as a rare-event classifier gives them."""
    pred = fx.predictions(spark, d).withColumn("prob", F.col("prob") * 0.0009)
    return rounded(evaluation.auc(pred), "auc")


@query
def rank_methods(spark, d):
    return rounded(evaluation.rank_methods(fx.predictions(spark, d)), "auc")


@query
def youden_cutoff(spark, d):
    return rounded(evaluation.youden_cutoff(fx.predictions_small(spark, d)), "cutoff")


def _reported(spark, d):
    """Long small predictions with the cutoff learned on test and used for both splits."""
    pred = fx.predictions_small(spark, d)
    return pred, evaluation.youden_cutoff(pred.filter("split = 'test'").drop("split"))


@query
def confusion_matrix(spark, d):
    return rounded(evaluation.confusion_matrix(*_reported(spark, d)), "share")


@query
def metrics_report(spark, d):
    return rounded(evaluation.metrics_report(*_reported(spark, d)), "value")


@query
def calibration_curve(spark, d):
    return rounded(evaluation.calibration_curve(fx.predictions(spark, d)), "prob_true", "prob_pred")


@query
def decision_curve(spark, d):
    return rounded(evaluation.decision_curve(fx.predictions(spark, d)), "net_benefit", "treat_all")


@query
def decision_curve_standard(spark, d):
    return rounded(evaluation.decision_curve(fx.predictions(spark, d), "standard"), "net_benefit", "treat_all")


@query
def pr_curve(spark, d):
    return rounded(evaluation.pr_curve(fx.predictions(spark, d)), "threshold", "precision", "recall")


@query
def average_precision(spark, d):
    return rounded(evaluation.average_precision(fx.predictions(spark, d)), "average_precision")


@query
def log_loss(spark, d):
    return rounded(evaluation.log_loss(fx.predictions(spark, d)), "log_loss")


@query
def run_summary(spark, d):
    split = frame.stratified_split(fx.wide_rows(spark, d), 0.3)
    best = evaluation.rank_methods(fx.predictions(spark, d)).filter("rank = 1").select("method", "rank")
    return evaluation.run_summary({"classes": frame.class_distribution(split), "best": best})
