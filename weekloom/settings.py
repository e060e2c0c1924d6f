"""Fixed values of the demand domain. All of them can be passed differently to the operators."""

# Rows of these sale types do not describe regular demand.
EXCLUDED_TYPES = ["E-COMMERCE", "OTROS", "KAM"]

# Descriptive columns that are not needed after cleaning.
DROPPED_COLUMNS = [
    "uom",
    "material_name",
    "tipo",
    "region",
    "promo_id",
    "promo_flag",
    "promo_type",
    "promo_mechanics",
]

# Closed date ranges.
FLAGGED_PERIOD = ("2020-03-01", "2022-04-30")
TRAINING_RANGE = ("2022-04-01", "2024-12-31")

# Least number of weeks of a series.
MIN_WEEKS_GOLD = 12
MIN_WEEKS_TRAINING = 56

# Weeks looked back by the row features.
LAGS = [1, 2, 4, 8, 12, 26, 52]
ROLLING_WINDOWS = [4, 8, 12, 52]

# Series descriptors, in the order of the feature vector, with their names in reports.
SERIES_FEATURES = {
    "total_liters": "Volumen Total (litros)",
    "mean_liters": "Volumen Medio (litros/semana)",
    "median_liters": "Volumen Mediana (litros/semana)",
    "max_liters": "Volumen Máximo (litros/semana)",
    "std_liters": "Desviación Estándar Volumen",
    "nonzero_weeks_count": "Semanas con Venta",
    "zero_ratio": "Ratio Semanas sin Venta",
    "mean_nonzero_liters": "Volumen Medio en Semanas con Venta",
    "median_nonzero_liters": "Mediana Volumen en Semanas con Venta",
    "std_nonzero_liters": "Desv. Est. en Semanas con Venta",
    "cv_squared": "Coeficiente Variación al Cuadrado",
    "adi": "Intervalo Medio entre Demandas (ADI)",
    "promo_lift": "Lift por Promoción",
}

# Categorical inputs of the models.
CATEGORICAL_FEATURES = [
    "establecimiento",
    "material",
    "year",
    "month",
    "week_of_year",
    "has_promo",
    "is_covid_period",
    "is_holiday_exact_date",
    "is_holiday_in_week",
]

# Clustering.
CLUSTER_SWEEP = range(2, 11)
CLUSTER_COUNT = 6
SEED = 42

# Holdout and folds.
TRAIN_RATIO = 0.8
TEST_WEEKS = 12
CV_FOLDS = 5
CV_FOLDS_CLUSTER = 3
BACKTEST_WEEKS = {"initial": 78, "period": 12, "horizon": 12}
MIN_POINTS_FIT = 12
MIN_POINTS_TUNING = 80

# Sampling of large clusters.
SAMPLE_FRACTION = 0.1
SAMPLE_FLOOR = 10_000
RECENT_ROWS = 100_000

# Search spaces, as (Spark ML parameter -> choices).
# Leaf counts of a leaf-wise tree become depths of a level-wise one; "no limit" is Spark's limit of 30.
BOOSTED_SPACE = {
    "maxIter": [50, 100, 200],
    "stepSize": [0.05, 0.1, 0.2],
    "maxDepth": [4, 5, 6],
    "minInstancesPerNode": [20, 50, 100],
    "subsamplingRate": [0.7, 0.8, 0.9],
    "featureSubsetStrategy": ["0.7", "0.8", "0.9"],
}
FOREST_SPACE = {
    "numTrees": [50, 100, 200],
    "maxDepth": [10, 20, 30],
    "minInstancesPerNode": [3, 5],
    "featureSubsetStrategy": ["sqrt", "log2", "0.7"],
}
BOOSTED_TRIALS = 10
FOREST_TRIALS = 5

# Base and meta models of the stack.
STACK_BASE_GLOBAL = {
    "lossType": "absolute",
    "stepSize": 0.05,
    "maxDepth": 8,
    "minInstancesPerNode": 50,
    "featureSubsetStrategy": "0.8",
    "subsamplingRate": 0.8,
    "maxIter": 2000,
}
STACK_BASE_CLUSTER = {
    "lossType": "absolute",
    "stepSize": 0.05,
    "maxDepth": 6,
    "minInstancesPerNode": 50,
    "featureSubsetStrategy": "0.7",
    "subsamplingRate": 0.7,
    "maxIter": 1000,
}
STACK_PATIENCE = 50
STACK_META_BOOSTED = {"maxIter": 200, "stepSize": 0.1, "maxDepth": 5}
RIDGE_ALPHA = 1.0

# Additive model.
ADDITIVE_GRID = {
    "seasonality_mode": ["additive", "multiplicative"],
    "changepoint_prior_scale": [0.001, 0.01, 0.1, 0.5],
    "seasonality_prior_scale": [0.01, 0.1, 1.0, 10.0],
}
ADDITIVE_DEFAULTS = {
    "seasonality_mode": "additive",
    "changepoint_prior_scale": 0.05,
    "seasonality_prior_scale": 10.0,
}
FORECAST_WEEKS = 12
FORECAST_COLUMNS = ["ds", "yhat", "yhat_lower", "yhat_upper", "trend", "weekly", "yearly"]

# Model used per cluster; clusters not listed take the default.
ROUTES = {
    0: "LightGBM",
    1: "LightGBM (Low Confidence)",
    2: "RandomForest",
    3: "LightGBM (Low Confidence)",
    4: "LightGBM",
    5: "LightGBM (Low Confidence)",
    6: "LightGBM",
}
DEFAULT_ROUTE = "LightGBM (Default)"
