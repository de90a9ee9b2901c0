"""Column lists, types, domains and business constants."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
COORD = T.DecimalType(9, 6)

# --- fixed values: raw column -> clean name, in file order ---
RAW_TO_CLEAN = {
    "CustomerID": "customer_id",
    "Count": "row_count_flag",
    "Country": "country",
    "State": "state",
    "City": "city",
    "Zip Code": "zip_code",
    "Lat Long": "lat_long_raw",
    "Latitude": "latitude",
    "Longitude": "longitude",
    "Gender": "gender",
    "Senior Citizen": "senior_citizen",
    "Partner": "has_partner",
    "Dependents": "has_dependents",
    "Tenure Months": "tenure_months",
    "Phone Service": "phone_service",
    "Multiple Lines": "multiple_lines",
    "Internet Service": "internet_service",
    "Online Security": "online_security",
    "Online Backup": "online_backup",
    "Device Protection": "device_protection",
    "Tech Support": "tech_support",
    "Streaming TV": "streaming_tv",
    "Streaming Movies": "streaming_movies",
    "Contract": "contract_type",
    "Paperless Billing": "paperless_billing",
    "Payment Method": "payment_method",
    "Monthly Charges": "monthly_charges",
    "Total Charges": "total_charges",
    "Churn Label": "churn_label",
    "Churn Value": "churn_flag",
    "Churn Score": "churn_score",
    "CLTV": "cltv",
    "Churn Reason": "churn_reason",
}
EXPECTED_COLUMNS = list(RAW_TO_CLEAN)

# --- fixed values: allowed categories of the raw table ---
DOMAINS = {
    "Gender": ["Male", "Female"],
    "Senior Citizen": ["Yes", "No"],
    "Partner": ["Yes", "No"],
    "Dependents": ["Yes", "No"],
    "Phone Service": ["Yes", "No"],
    "Internet Service": ["DSL", "Fiber optic", "No"],
    "Contract": ["Month-to-month", "One year", "Two year"],
    "Paperless Billing": ["Yes", "No"],
    "Churn Label": ["Yes", "No"],
}

ACTIVE_REASON = "Not Applicable - Active Customer"

# --- fixed values: stated reasons for leaving ---
CHURN_REASONS = [
    "Competitor made better offer",
    "Moved",
    "Competitor had better devices",
    "Competitor offered higher download speeds",
    "Competitor offered more data",
    "Price too high",
    "Product dissatisfaction",
    "Service dissatisfaction",
    "Lack of self-service on Website",
    "Network reliability",
    "Limited range of services",
    "Lack of affordable download/upload speed",
    "Long distance charges",
    "Extra data charges",
    "Don't know",
    "Poor expertise of online support",
    "Poor expertise of phone support",
    "Attitude of service provider",
    "Attitude of support person",
    "Deceased",
]

# --- fixed values: payment methods, add-on services, cohorts ---
PAYMENT_METHODS = [
    "Mailed check",
    "Electronic check",
    "Bank transfer (automatic)",
    "Credit card (automatic)",
]
CONTRACTS = ["Month-to-month", "One year", "Two year"]
INTERNET = ["Fiber optic", "DSL", "No"]
ADDONS = [
    "online_security",
    "online_backup",
    "device_protection",
    "tech_support",
    "streaming_tv",
    "streaming_movies",
]
NO_INTERNET = "No internet service"
YES_NO_COLUMNS = [
    "senior_citizen",
    "has_partner",
    "has_dependents",
    "phone_service",
    "paperless_billing",
    "churn_label",
]
# label -> (upper bound in months, sort order); a cohort runs from the previous bound, exclusive
COHORTS = {
    "0-12 mo": (12, 1),
    "13-24 mo": (24, 2),
    "25-36 mo": (36, 3),
    "37-48 mo": (48, 4),
    "49-60 mo": (60, 5),
    "61-72 mo": (72, 6),
}
# --- fixed values: risk tier and points of each contract ---
RISK_TIERS = {"Month-to-month": "High", "One year": "Medium", "Two year": "Low"}
CONTRACT_POINTS = {"Two year": 100, "One year": 60}
CONTRACT_POINTS_OTHER = 20

# --- fixed values: variables of the test suites ---
CATEGORICAL_VARS = [
    "contract_type",
    "internet_service",
    "payment_method",
    "gender",
    "senior_citizen",
    "has_partner",
    "has_dependents",
    "paperless_billing",
    "tenure_cohort",
    "online_security",
    "tech_support",
    "streaming_tv",
    "streaming_movies",
    "multiple_lines",
]
NUMERIC_VARS = [
    "tenure_months",
    "monthly_charges",
    "total_charges",
    "churn_score",
    "cltv",
    "addon_service_count",
    "avg_revenue_per_tenure_month",
]

_INT = {"Count", "Tenure Months", "Churn Value", "Churn Score", "CLTV"}
_TYPES = {"Latitude": COORD, "Longitude": COORD, "Monthly Charges": MONEY}


def _raw_type(name):
    if name in _INT:
        return T.IntegerType()
    return _TYPES.get(name, T.StringType())


RAW_SCHEMA = T.StructType([T.StructField(c, _raw_type(c)) for c in EXPECTED_COLUMNS])
CROSS_SCHEMA = T.StructType(
    [
        T.StructField("customerID", T.StringType()),
        T.StructField("MonthlyCharges", T.DoubleType()),
        T.StructField("Churn", T.StringType()),
    ]
)
# --- fixed values: columns that make a service plan ---
SERVICE_PLAN_COLUMNS = [
    "contract_type",
    "internet_service",
    "phone_service",
    "multiple_lines",
    *ADDONS,
    "paperless_billing",
]
