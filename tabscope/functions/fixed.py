"""Names, formats and tokens that results depend on."""

# KPI aggregations offered for number fields.
NUMBER_AGGREGATIONS = (
    "sum",
    "average",
    "minimum",
    "maximum",
    "count_distinct",
    "count",
    "std_deviation",
    "variance",
    "median",
)

# KPI aggregations offered for category fields.
CATEGORY_AGGREGATIONS = ("first", "last", "count_distinct", "count")

# Chart names.
CHART_NAMES = (
    "line_chart",
    "bar_chart",
    "area_chart",
    "donut_chart",
    "histogram",
    "pie_chart",
    "scatter_plot",
    "heatmap",
    "waterfall",
    "column_chart",
    "bubble_chart",
    "radar_chart",
    "map_chart",
)

# Cleansing step names.
CLEANSING_STEPS = (
    "delete_missing_row",
    "delete_duplicate_row",
    "data_type_conversion",
    "delete_row_outlier",
    "impute_by_mean",
    "impute_by_mode",
    "remove_missing_cell",
)

# Bin rules of the histogram.
BIN_RULES = ("fd", "sturges", "rice", "sqrt", "doane", "scott", "custom")

# Columns that may name a country, in order of preference.
LOCATION_COLUMNS = ("NAME", "SOVEREIGNT", "ADMIN", "COUNTRY", "REGION_UN")

# File kind by extension.
FILE_KINDS = {
    ".csv": "csv",
    ".txt": "text",
    ".jpg": "image",
    ".jpeg": "image",
    ".png": "image",
    ".pdf": "pdf",
}

# Date formats tried in this order, each with the shape of text it can read.
DATE_FORMATS = (
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
)

# Written-out and timed forms tried after DATE_FORMATS; "iso" stands for a cast to timestamp.
FREE_DATE_FORMATS = (
    (
        "iso",
        r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?( ?(Z|[+-]\d{2}:?\d{2}))?$",
    ),
    ("yyyyMMdd", r"^\d{8}$"),
    ("yyyy/M/d H:mm:ss", r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$"),
    ("M/d/yyyy H:mm", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$"),
    ("M/d/yyyy H:mm:ss", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$"),
    ("MMM d, yyyy", r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$"),
    ("MMMM d, yyyy", r"^[A-Z][a-z]{2,8} \d{1,2}, \d{4}$"),
    ("d MMM yyyy", r"^\d{1,2} [A-Z][a-z]{2} \d{4}$"),
    ("d MMMM yyyy", r"^\d{1,2} [A-Z][a-z]{2,8} \d{4}$"),
    ("d-MMM-yyyy", r"^\d{1,2}-[A-Z][a-z]{2}-\d{4}$"),
    # Any mixture of what the grammar of functions/free_dates.py reads.
    ("free", r"(?i)^ *[a-z0-9][a-z0-9 ,./:+-]*\d[a-z0-9 ,./:+-]*$"),
    ("free, day first", r"(?i)^ *[a-z0-9][a-z0-9 ,./:+-]*\d[a-z0-9 ,./:+-]*$"),
)

# Shapes of text that count as a date in the column analysis.
DATE_SHAPES = (r"^\d{4}-\d{2}-\d{2}$", r"^\d{2}/\d{2}/\d{4}$", r"^\d{2}-\d{2}-\d{4}$")

# Texts that count as a truth value in the column analysis.
TRUTH_TEXTS = ("true", "false", "0", "1")

# Cell texts that mean "missing" in a plain CSV file.
MISSING_TEXTS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Cell texts that mean "missing" when a file is read for a profile.
PROFILE_MISSING_TEXTS = ("", "NULL")

# Group and category cut-offs of the charts.
CHART_GROUPS = 10
CHART_BINS = 15
HEATMAP_ROWS = 16
DATETIME_BINS = 10
CUSTOM_BINS = 10
TOP_VALUES = 5
SAMPLE_VALUES = 5

# Page sizes.
PAGE_SIZE = 100
MAX_PAGE_SIZE = 1_000_000
LIST_PAGE_SIZE = 10

# Outlier limits.
IQR_FENCE = 1.5
Z_LIMIT = 3.0

# Fixed value: the type name of a column's document.
COLUMN_DOCUMENT = "OBJECT_TYPE_TABLE_COLUMN"
