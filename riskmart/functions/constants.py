"""Fixed values that results depend on.

FIXED VALUES — these must stay exactly as listed for results to match the
encounter-level risk application this library reproduces. They are listed in
their natural order.
"""

# ---- FIXED VALUES: age bucket text -> numeric midpoint; unknown -> 55 ----
AGE_MAP = {
    "[0-10)": 5, "[10-20)": 15, "[20-30)": 25, "[30-40)": 35,
    "[40-50)": 45, "[50-60)": 55, "[60-70)": 65, "[70-80)": 75,
    "[80-90)": 85, "[90-100)": 95,
}
AGE_DEFAULT = 55

# ---- FIXED VALUES: age groups, right-closed bins ----
AGE_EDGES = [0, 20, 40, 60, 80, 100]
AGE_LABELS = ["0-20", "21-40", "41-60", "61-80", "81-100"]

# ---- FIXED VALUES: medication-count bins, right-closed ----
MED_EDGES = [0, 5, 10, 20, 50, 100]
MED_LABELS = ["very_low", "low", "medium", "high", "very_high"]

# ---- FIXED VALUES: risk bands ----
RISK_EDGES = [0.0, 0.3, 0.6, 1.0]
RISK_LABELS = ["Low", "Medium", "High"]
RISK_LEVELS = ["Low", "Medium", "High"]

# ---- FIXED VALUES: ICD-9 code ranges -> category, checked in this order ----
# (category, inclusive low, high, high inclusive?, extra single codes)
DIAG_RANGES = [
    ("Circulatory", 390, 459, True, [785]),
    ("Respiratory", 460, 519, True, [786]),
    ("Digestive", 520, 579, True, [787]),
    ("Diabetes", 250, 251, False, []),
    ("Injury", 800, 999, True, []),
    ("Musculoskeletal", 710, 739, True, []),
    ("Genitourinary", 580, 629, True, [788]),
    ("Neoplasms", 140, 239, True, []),
]
DIAG_PREFIXES = [("E", "External"), ("V", "Supplementary")]
DIAG_NULL_TOKENS = ["Unknown", "nan", "?"]
DIAG_DEFAULT = "Other"

# ---- FIXED VALUES: the 21 medication columns ----
MEDICATION_COLS = [
    "metformin", "repaglinide", "nateglinide", "chlorpropamide",
    "glimepiride", "acetohexamide", "glipizide", "glyburide",
    "tolbutamide", "pioglitazone", "rosiglitazone", "acarbose",
    "miglitol", "troglitazone", "tolazamide", "insulin",
    "glyburide-metformin", "glipizide-metformin",
    "glimepiride-pioglitazone", "metformin-rosiglitazone",
    "metformin-pioglitazone",
]

# ---- FIXED VALUES: columns dropped by the cleaning job ----
DROP_COLUMNS = [
    "weight", "payer_code", "medical_specialty", "encounter_id",
    "patient_nbr", "examide", "citoglipton",
]
DIAG_COLUMNS = ["diag_1", "diag_2", "diag_3"]
VISIT_COLUMNS = ["number_inpatient", "number_outpatient", "number_emergency"]
NUMERIC_RAW_COLUMNS = [
    "num_medications", "num_lab_procedures", "num_procedures",
    "number_inpatient", "number_outpatient", "number_emergency",
    "time_in_hospital", "number_diagnoses",
]

# ---- FIXED VALUES: label-encoded columns ----
LABEL_ENCODE_COLS = [
    "race", "gender", "age",
    "diag_1_category", "diag_2_category", "diag_3_category",
    "max_glu_serum", "A1Cresult", "change", "diabetesMed",
]

# ---- FIXED VALUES: the 50 raw encounter columns, in table order ----
RAW_COLUMNS = [
    "encounter_id", "patient_nbr", "race", "gender", "age", "weight",
    "admission_type_id", "discharge_disposition_id", "admission_source_id",
    "time_in_hospital", "payer_code", "medical_specialty",
    "num_lab_procedures", "num_procedures", "num_medications",
    "number_outpatient", "number_emergency", "number_inpatient",
    "diag_1", "diag_2", "diag_3", "number_diagnoses",
    "max_glu_serum", "A1Cresult",
    "metformin", "repaglinide", "nateglinide", "chlorpropamide", "glimepiride",
    "acetohexamide", "glipizide", "glyburide", "tolbutamide", "pioglitazone",
    "rosiglitazone", "acarbose", "miglitol", "troglitazone", "tolazamide",
    "examide", "citoglipton", "insulin",
    "glyburide-metformin", "glipizide-metformin", "glimepiride-pioglitazone",
    "metformin-rosiglitazone", "metformin-pioglitazone",
    "change", "diabetesMed", "readmitted",
]
assert len(RAW_COLUMNS) == 50

# ---- FIXED VALUES: fill for raw columns a source does not supply (bronze alignment) ----
RAW_FILL_UNKNOWN = ["weight", "payer_code", "medical_specialty"]      # -> "?"
RAW_FILL_NO = MEDICATION_COLS + ["examide", "citoglipton"]              # -> "No"

# ---- FIXED VALUES: missing-value tokens of the CSV reader ----
NULL_TOKENS = ["?", "", "None", "NA", "NULL", "nan", "NaN", "N/A", "null"]

# ---- FIXED VALUES: thresholds ----
HIGH_LAB_CONSTANT = 44          # constant threshold used by the scorer
HIGH_LAB_CONSTANT_ALT = 57      # constant threshold used by the record generator
HIGH_LAB_QUANTILE = 0.75
READMIT_TOKEN = "<30"
MODEL_VERSION = "1.0.0"
FALLBACK_SCORE = 0.5            # streaming score when the model gives none
FALLBACK_LEVEL = "Medium"

# ---- FIXED VALUES: feature display names ----
FEATURE_DISPLAY_NAMES = {
    "number_inpatient": "Previous Inpatient Visits",
    "number_emergency": "Emergency Visits",
    "number_outpatient": "Outpatient Visits",
    "total_visits": "Total Hospital Visits",
    "num_medications": "Number of Medications",
    "num_lab_procedures": "Lab Procedures Count",
    "num_procedures": "Procedures Performed",
    "time_in_hospital": "Length of Stay (Days)",
    "number_diagnoses": "Number of Diagnoses",
    "age_numeric": "Patient Age",
    "age": "Age Group",
    "insulin": "Insulin Prescribed",
    "medication_change": "Medication Changed",
    "high_lab_procedures": "High Lab Procedure Count",
    "total_medications_active": "Active Medications",
    "diabetesMed": "Diabetes Medication",
    "A1Cresult": "A1C Test Result",
    "max_glu_serum": "Glucose Serum Level",
    "diag_1_category": "Primary Diagnosis",
    "diag_2_category": "Secondary Diagnosis",
    "diag_3_category": "Tertiary Diagnosis",
    "discharge_disposition_id": "Discharge Disposition",
    "admission_type_id": "Admission Type",
    "admission_source_id": "Admission Source",
    "race": "Race",
    "gender": "Gender",
    "change": "Medication Change Flag",
}

# ---- FIXED VALUES: recommendation per risk level (Low is the default) ----
RECOMMENDATIONS = {
    "High": (
        "⚠️ HIGH RISK: Schedule follow-up within 7 days. "
        "Review medication plan, ensure patient education on self-management, "
        "and consider home health referral."
    ),
    "Medium": (
        "⚡ MODERATE RISK: Schedule follow-up within 14 days. "
        "Review discharge instructions and medication adherence plan."
    ),
    "Low": (
        "✅ LOW RISK: Standard discharge protocol. "
        "Schedule routine follow-up within 30 days."
    ),
}

# ---- FIXED VALUES: risk level colours of the BI report; other -> grey ----
LEVEL_COLOURS = {"High": "#f56565", "Medium": "#ecc94b", "Low": "#48bb78"}
LEVEL_COLOUR_DEFAULT = "#a0aec0"

# ---- FIXED VALUES: age-group proxy of the fallback score; unknown -> 3 ----
AGE_GROUP_PROXY = {"0-20": 1, "21-40": 2, "41-60": 3, "61-80": 4, "81-100": 5}
AGE_GROUP_PROXY_DEFAULT = 3

# ---- FIXED VALUES: scoring-input field rules (name, default, minimum, maximum) ----
INPUT_RULES = [
    ("age", None, 0, 100),
    ("gender", None, None, None),
    ("race", "Unknown", None, None),
    ("time_in_hospital", 1, 1, None),
    ("num_lab_procedures", 0, 0, None),
    ("num_procedures", 0, 0, None),
    ("num_medications", 0, 0, None),
    ("number_outpatient", 0, 0, None),
    ("number_emergency", 0, 0, None),
    ("number_inpatient", 0, 0, None),
    ("number_diagnoses", 1, 1, None),
    ("max_glu_serum", "None", None, None),
    ("A1Cresult", "None", None, None),
    ("change", "No", None, None),
    ("diabetesMed", "No", None, None),
    ("admission_type_id", 1, None, None),
    ("discharge_disposition_id", 1, None, None),
    ("admission_source_id", 1, None, None),
    ("diag_1_category", "Other", None, None),
    ("diag_2_category", "Other", None, None),
    ("diag_3_category", "Other", None, None),
    ("insulin", "No", None, None),
    ("metformin", "No", None, None),
]

# ---- FIXED VALUES: histogram bin counts of the dashboards ----
HIST_BINS_PROFILE = 40
HIST_BINS_PERSONA = 14
CORR_THRESHOLD = 0.3
