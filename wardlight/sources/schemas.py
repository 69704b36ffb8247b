"""Input and output schemas. Readers take types from here; ``sources.inference`` is for files without a schema."""

_ID, _TEXT, _INT, _NUM = "long", "string", "int", "double"


def _ddl(**columns: str) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in columns.items())


ENCOUNTERS = _ddl(
    encounter_id=_ID, patient_nbr=_ID, race=_TEXT, gender=_TEXT, age=_TEXT, weight=_TEXT,
    admission_type_id=_INT, discharge_disposition_id=_INT, admission_source_id=_INT, time_in_hospital=_INT,
    payer_code=_TEXT, medical_specialty=_TEXT, primary_diagnosis_code=_TEXT, other_diagnosis_codes=_TEXT,
    number_outpatient=_INT, number_inpatient=_INT, number_emergency=_INT, num_lab_procedures=_INT,
    number_diagnoses=_INT, num_medications=_INT, num_procedures=_INT, ndc_code=_TEXT, max_glu_serum=_TEXT,
    A1Cresult=_TEXT, change=_TEXT, readmitted=_TEXT,
)
APPOINTMENTS = _ddl(
    appointment_id=_TEXT, patient_id=_TEXT, doctor_id=_TEXT, appointment_date=_TEXT, appointment_time=_TEXT,
    reason_for_visit=_TEXT, status=_TEXT,
)
DOCTORS = _ddl(doctor_id=_TEXT, specialization=_TEXT, years_experience=_INT, hospital_branch=_TEXT)
PATIENTS = _ddl(patient_id=_TEXT, gender=_TEXT, date_of_birth=_TEXT, insurance_provider=_TEXT, registration_date=_TEXT)
BILLING = _ddl(patient_id=_TEXT, amount=_NUM, payment_status=_TEXT, payment_method=_TEXT)
TREATMENTS = _ddl(treatment_id=_TEXT, appointment_id=_TEXT, cost=_NUM)
HOSPITAL = {
    "appointments": APPOINTMENTS, "billing": BILLING, "doctors": DOCTORS, "patients": PATIENTS, "treatments": TREATMENTS,
}

OUTCOMES = _ddl(
    patient_id=_TEXT, predicted_risk=_NUM, actually_readmitted=_INT, recorded_at="timestamp", notes=_TEXT,
)
METRICS = _ddl(
    status=_TEXT, current_auc=_NUM, new_auc=_NUM, improvement=_NUM, model_saved="boolean", retrained_at="timestamp",
    training_samples=_ID,
)
REQUESTS = _ddl(patient_id=_TEXT, patient_data="map<string,string>", notify_email=_TEXT)

FHIR_PATIENT = "id string, name array<struct<given:array<string>,family:string>>, gender string, birthDate string"


UNREADABLE = "unreadable"
_SUBJECT = "subject:struct<reference:string>"


def _bundle(resource: str, head: str = "") -> str:
    return f"patient_id string, {head}entry array<struct<resource:struct<{resource},{_SUBJECT}>>>"


FHIR_CONDITION = _bundle("code:struct<text:string,coding:array<struct<code:string>>>")
FHIR_MEDICATION = _bundle("medicationCodeableConcept:struct<text:string>")
FHIR_ENCOUNTER = _bundle("class:struct<code:string>")
FHIR_OBSERVATION = _bundle("id:string", "total int, ")
FHIR = {
    "Patient": FHIR_PATIENT, "Condition": FHIR_CONDITION, "MedicationRequest": FHIR_MEDICATION,
    "Encounter": FHIR_ENCOUNTER, "Observation": FHIR_OBSERVATION,
}
