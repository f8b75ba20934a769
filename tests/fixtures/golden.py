"""Published export values used as golden data (copied as fixed values)."""

# FIXED VALUES: risk by demographics export
# (age_group, gender, avg_risk, patient_count, high_risk_count)
RISK_BY_DEMOGRAPHICS = [
    ("0-20", "Female", 0.2729892670157068, 382, 10),
    ("0-20", "Male", 0.26417882736156356, 307, 4),
    ("21-40", "Female", 0.27874962930658526, 2293, 93),
    ("21-40", "Male", 0.2752407045009785, 1533, 66),
    ("41-60", "Female", 0.2782257430997877, 9420, 406),
    ("41-60", "Male", 0.27443135832325677, 9924, 378),
    ("61-80", "Female", 0.28956214782707884, 17534, 1027),
    ("61-80", "Male", 0.2887851860758732, 16633, 952),
    ("61-80", "Unknown/Invalid", 0.19026666666666667, 3, 0),
    ("81-100", "Female", 0.29452141495950457, 8396, 526),
    ("81-100", "Male", 0.28497751816218336, 5093, 306),
]
TOTAL_PATIENTS = 71518
TOTAL_HIGH_RISK = 3768

# FIXED VALUES: readmission trends export (month, total_patients, readmissions, rate)
READMISSION_TRENDS = [
    ("2024-01-01", 528, 71, 13.4), ("2024-02-01", 583, 97, 16.6),
    ("2024-03-01", 303, 94, 31.0), ("2024-04-01", 687, 69, 10.0),
    ("2024-05-01", 633, 103, 16.3), ("2024-06-01", 502, 36, 7.2),
    ("2024-07-01", 386, 31, 8.0), ("2024-08-01", 793, 116, 14.6),
    ("2024-09-01", 759, 63, 8.3), ("2024-10-01", 539, 80, 14.8),
    ("2024-11-01", 613, 41, 6.7), ("2024-12-01", 410, 85, 20.7),
]
