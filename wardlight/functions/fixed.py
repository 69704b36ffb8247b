"""Fixed values.

Everything here has to equal the published behaviour exactly for results to
match, so it is written out plainly. Nothing in this file is logic.
"""

# Text cells that a CSV reader treats as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

MISSING_SENTINEL = "?"
LABEL = "readmitted_30d"

# Age bracket -> midpoint.
AGE_MIDPOINTS = {
    "[0-10)": 5, "[10-20)": 15, "[20-30)": 25, "[30-40)": 35, "[40-50)": 45,
    "[50-60)": 55, "[60-70)": 65, "[70-80)": 75, "[80-90)": 85, "[90-100)": 95,
}
ELDERLY_AGE = 65

# Age band label -> inclusive upper edge; the lower edge 0 is exclusive.
AGE_BANDS = [("<30", 30), ("30-50", 50), ("50-65", 65), ("65-80", 80), ("80+", 100)]

GLUCOSE_LEVELS = {"None": 0, "Norm": 1, ">200": 2, ">300": 3}
A1C_LEVELS = {"None": 0, "Norm": 1, ">7": 2, ">8": 3}

HIGH_RISK_DISPOSITIONS = [2, 3, 4, 5, 6, 8, 9, 15, 16, 17]
EXCLUDED_DISPOSITIONS = [11, 13, 14, 19, 20, 21]

# Diagnosis category, lowest code, highest code (both inclusive), extra code.
DIAGNOSIS_RANGES = [
    ("Circulatory", 390, 459, 785),
    ("Respiratory", 460, 519, 786),
    ("Digestive", 520, 579, 787),
    ("Diabetes", 250, 250.99, None),
    ("Injury", 800, 999, None),
    ("Musculoskeletal", 710, 739, None),
    ("Genitourinary", 580, 629, 788),
    ("Neoplasms", 140, 239, None),
]

ENCOUNTER_UNUSED = ["weight", "ndc_code", "payer_code"]
ENCOUNTER_IDS = [
    "encounter_id", "patient_nbr", "admission_type_id", "admission_source_id",
    "discharge_disposition_id",
]
ENCOUNTER_CATEGORIES = ["race", "medical_specialty", "primary_diag_category", "age_group"]

# Hospital star schema.
HOSPITAL_AGE_DATE = "2024-01-01"
HIGH_RISK_SPECIALTIES = ["Cardiology", "Internal Medicine", "Nephrology", "Pulmonology"]
HOSPITAL_CATEGORIES = ["specialization", "hospital_branch", "insurance_provider"]
HOSPITAL_UNUSED = [
    "appointment_id", "doctor_id", "appointment_date", "appointment_time",
    "reason_for_visit", "status", "date_of_birth", "registration_date", "gender",
]

# Scoring.
DECISION_THRESHOLD = 0.369
MEDIUM_CUT = 0.3
HIGH_CUT = 0.6
BANDS = ["High", "Medium", "Low"]
RECOMMENDATIONS = {
    "High": [
        "Schedule follow-up within 48 hours of discharge",
        "Assign case manager for post-discharge support",
        "Review medication plan with pharmacist",
        "Arrange home health visit if needed",
    ],
    "Medium": [
        "Schedule follow-up within 7 days of discharge",
        "Provide patient education on warning signs",
        "Confirm prescription filled before discharge",
    ],
    "Low": [
        "Standard discharge protocol",
        "Provide contact number for questions",
    ],
}

# Feedback loop.
BASELINE_AUC = 0.6812
DRIFT_AUC = 0.60
MIN_OUTCOMES = 50

# FHIR code fragments.
CARDIAC_CODES = ["I21", "I22", "I50", "I48", "410", "428"]
DIABETES_CODES = ["E11", "E12", "E13", "250"]
# Encounter class -> fragments of its code, tested in this order.
CLASS_FRAGMENTS = [
    ("inpatient", ["inp", "acute"]),
    ("outpatient", ["out"]),
    ("emergency", ["eme"]),
]

# Note annotation: score field -> value used when the note cannot be read.
NOTE_SCORES = {
    "social_isolation_score": 0,
    "medication_noncompliance_risk": 0,
    "mental_health_flag": 0,
    "caregiver_support": 2,
    "follow_up_arranged": 0,
    "substance_abuse_flag": 0,
    "fall_risk": 0,
    "cognitive_impairment": 0,
    "financial_stress": 0,
    "transport_barrier": 0,
    "overall_psychosocial_risk": 0,
}
NOTE_LISTS = ["key_risk_factors", "recommended_interventions"]
NOTE_UNREADABLE = "Unable to analyze notes"
# Annotation field -> patient feature it becomes.
NOTE_FEATURES = {
    "social_isolation_score": "social_isolation_score",
    "medication_noncompliance_risk": "medication_noncompliance",
    "mental_health_flag": "mental_health_flag",
    "caregiver_support": "caregiver_support",
    "follow_up_arranged": "follow_up_arranged",
    "overall_psychosocial_risk": "psychosocial_risk_score",
}

# Care pathways.
PRIORITY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "URGENT": 4}
NO_FOLLOW_UP_DAYS = 999
ACTION_PLAN_LENGTH = 10
# id, name, priority, colour, follow-up days, actions, specialists
PATHWAYS = [
    ("cardiac_high_risk", "Cardiac High-Risk Pathway", "URGENT", "red", 2,
     ["Schedule cardiology follow-up within 48 hours",
      "Arrange cardiac rehabilitation assessment",
      "Daily remote monitoring for first 2 weeks",
      "Medication reconciliation with cardiologist",
      "Patient education on warning signs"],
     ["Cardiologist", "Cardiac Nurse", "Pharmacist"]),
    ("diabetes_high_risk", "Diabetes Management Pathway", "URGENT", "red", 2,
     ["Schedule endocrinology review within 48 hours",
      "HbA1c and glucose monitoring plan",
      "Diabetes nurse educator referral",
      "Medication adherence assessment",
      "Dietary counselling referral"],
     ["Endocrinologist", "Diabetes Nurse", "Dietitian"]),
    ("elderly_high_risk", "Elderly High-Risk Pathway", "URGENT", "red", 1,
     ["Arrange home health visit within 24 hours",
      "Social work assessment for home support",
      "Falls risk assessment",
      "Medication review for polypharmacy",
      "Cognitive assessment if indicated",
      "Family/carer education session"],
     ["Geriatrician", "Social Worker", "Occupational Therapist"]),
    ("mental_health_risk", "Mental Health Support Pathway", "HIGH", "orange", 3,
     ["Psychiatry or psychology consult within 72 hours",
      "Mental health crisis plan provided",
      "Community mental health team referral",
      "Medication compliance support",
      "Support network assessment"],
     ["Psychiatrist", "Psychologist", "Mental Health Nurse"]),
    ("social_isolation_risk", "Social Support Pathway", "HIGH", "orange", 3,
     ["Social worker referral within 48 hours",
      "Community support services assessment",
      "Transport assistance arrangement",
      "Meals on wheels referral if needed",
      "Volunteer visitor program referral"],
     ["Social Worker", "Community Health Nurse"]),
    ("medication_risk", "Medication Management Pathway", "HIGH", "orange", 5,
     ["Pharmacist medication review before discharge",
      "Blister pack dispensing arrangement",
      "Medication reminder system setup",
      "Patient education on each medication",
      "GP follow-up within 5 days"],
     ["Pharmacist", "GP", "Medication Nurse"]),
    ("standard_medium_risk", "Standard Medium-Risk Pathway", "MEDIUM", "yellow", 7,
     ["GP follow-up within 7 days",
      "Discharge summary sent to GP",
      "Patient education materials provided",
      "Contact number for questions provided",
      "Outpatient review if needed"],
     ["GP"]),
    ("standard_low_risk", "Standard Discharge Protocol", "LOW", "green", 14,
     ["Standard discharge instructions provided",
      "GP follow-up within 14 days",
      "Emergency contact number provided"],
     ["GP"]),
]
