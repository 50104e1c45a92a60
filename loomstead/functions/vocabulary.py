"""Fixed values that the text functions look things up in."""

from __future__ import annotations

# Known investigator roles.
INVESTIGATOR_ROLES = [
    "PRINCIPAL_INVESTIGATOR", "SUB_INVESTIGATOR", "STUDY_DIRECTOR", "STUDY_CHAIR", "STUDY_CO_CHAIR", "STUDY_COORDINATOR", "INVESTIGATOR",
    "CO_INVESTIGATOR",
]

# Companies whose name begins a sponsor's name.
COMPANIES = [
    "PFIZER", "ROCHE", "NOVARTIS", "ASTRAZENECA", "MERCK", "SANOFI", "BAYER", "TAKEDA", "AMGEN", "GILEAD", "BIOGEN", "ABBVIE", "REGENERON", "MODERNA",
    "BIONTECH", "CELGENE", "MYLAN", "TEVA", "SANDOZ", "MEDTRONIC", "STRYKER", "BAUSCH", "VIATRIS", "BOEHRINGER", "GSK", "CHUGAI", "UCB",
    "BRISTOL-MYERS", "BRISTOL", "MEDIMMUNE",
]

# Whole names that are no persons.
NOT_PERSONS = ["USE CENTRAL CONTACT", "BRISTOL-MYERS SQUIBB", "BRISTOL MYERS SQUIBB"]

# Words and phrases of organisations.
ORGANISATION_WORDS = [
    "UNIVERSITY", "COLLEGE", "INSTITUTE", "HOSPITAL", "CLINIC", "LABORATORY", "LABORATORIES", "LAB", "FOUNDATION", "DEPARTMENT", "COMMITTEE",
    "ASSOCIATION", "CORPORATION", "COMPANY", "PHARMA", "PHARMACEUTICAL", "BIOTECH", "BIOSCIENCE", "BIOSCIENCES", "THERAPEUTICS", "MEDICAL CENTER",
    "CANCER CENTER", "HEALTH SYSTEM", "HEALTHCARE", "NATIONAL INSTITUTE", "SCHOOL OF", "COLLEGE OF", "OFFICE OF", "CENTER FOR", "CENTRE FOR",
    "INSTITUTE OF", "DIVISION OF", "DEPARTMENT OF", "BOARD OF", "MINISTRY OF", "FUND FOR", "RESEARCH INSTITUTE", "RESEARCH CENTER",
    "RESEARCH CENTRE", "CLINICAL RESEARCH", "CLINICAL TRIAL", "CLINICAL TRIALS", "LIMITED LIABILITY", "SOCIETE", "GESELLSCHAFT", "GMBH",
    "AKTIENGESELLSCHAFT", "AG", "NV", "PTY", "PTY LTD", "AND ASSOCIATES", "AND COMPANY", "& CO", "& ASSOCIATES", "DIRECTOR", "MEDICAL", "STUDY",
    "CLINICAL", "REGISTRY", "MONITOR", "COORDINATOR", "MANAGEMENT", "RESPONSIBLE", "CALL CENTER", "CENTER", "CORPORATE", "CARE", "TBD", "SPONSOR",
]

# What begins a role and not a name.
ROLE_PREFIXES = ["CONTACT FOR", "CONTACT", "STUDY DIRECTOR", "SCIENTIFIC CONTACT", "PUBLIC QUERIES", "PUBLIC CONTACT", "SPONSOR"]

# Last words of companies.
CORPORATE_SUFFIXES = ["INC", "LTD", "LLC", "CORP", "CORPORATION", "GMBH", "NV", "PLC", "SA", "SARL", "PTY", "LIMITED", "COMPANY"]

# Titles before a name, and degrees and generations after it.
TITLES = [
    "DR", "PROF", "MR", "MRS", "MS", "MX", "SIR", "DAME", "CAPT", "COL", "MAJ", "LT", "CPT", "CPL", "SGT", "REV", "FR", "PASTOR", "RABBI", "IMAM",
    "HON", "SEN", "GOV", "REP", "AMB",
]
DEGREES = [
    "MD", "DO", "DDS", "DMD", "PHD", "EDD", "JD", "LLB", "LLM", "PHARMD", "RPH", "MPH", "MSN", "RN", "NP", "PA", "CNS", "APRNP", "MBA", "MS", "MA",
    "BS", "BA", "BSC", "FACS", "FACE", "FACC", "ASCO", "FASH", "DC", "OD", "DPM", "DVM", "VMD", "JR", "SR", "II", "III", "IV",
]

# Short medical terms that are keywords.
SHORT_TERMS = [
    "HIV", "HPV", "ALS", "MS", "IBS", "COPD", "ICU", "GI", "ENT", "CT", "MRI", "PET", "CVD", "CHF", "CAD", "CKD", "UTI", "STD", "PTSD", "ADHD",
    "GERD", "RA", "SLE", "NASH", "NAFLD", "OSA", "PCOS", "TBI", "SCI",
]

# Acronyms and what they stand for.
ACRONYMS = {
    "MI": "myocardial infarction", "CVA": "cerebrovascular accident", "DKA": "diabetic ketoacidosis", "PE": "pulmonary embolism",
    "DVT": "deep vein thrombosis", "ARDS": "acute respiratory distress syndrome", "MRSA": "methicillin-resistant staphylococcus aureus",
    "AF": "atrial fibrillation", "HF": "heart failure", "ACS": "acute coronary syndrome", "PAD": "peripheral artery disease",
    "TIA": "transient ischemic attack", "VTE": "venous thromboembolism", "AAA": "abdominal aortic aneurysm", "ESRD": "end-stage renal disease",
    "HTN": "hypertension", "DM": "diabetes mellitus", "T2DM": "type 2 diabetes mellitus", "T1DM": "type 1 diabetes mellitus",
    "CLL": "chronic lymphocytic leukemia", "AML": "acute myeloid leukemia", "OA": "osteoarthritis",
    "COPD": "chronic obstructive pulmonary disease", "HIV": "human immunodeficiency virus", "HPV": "human papillomavirus",
    "UTI": "urinary tract infection", "GERD": "gastroesophageal reflux disease", "NASH": "non-alcoholic steatohepatitis",
    "NAFLD": "non-alcoholic fatty liver disease", "OSA": "obstructive sleep apnea", "PCOS": "polycystic ovary syndrome",
    "TBI": "traumatic brain injury", "SCI": "spinal cord injury", "CHF": "congestive heart failure", "CAD": "coronary artery disease",
    "CVD": "cardiovascular disease", "IBS": "irritable bowel syndrome", "PTSD": "post-traumatic stress disorder",
    "ADHD": "attention deficit hyperactivity disorder", "SLE": "systemic lupus erythematosus", "RA": "rheumatoid arthritis",
    "MS": "multiple sclerosis", "ALS": "amyotrophic lateral sclerosis", "CKD": "chronic kidney disease",
    "STD": "sexually transmitted disease", "CT": "computed tomography", "MRI": "magnetic resonance imaging",
    "PET": "positron emission tomography",
}

# Keywords on a study's design that stay although they are blocked.
DESIGN_TERMS = [
    "RANDOMIZED CONTROLLED TRIAL", "RANDOMIZED CLINICAL TRIAL", "RANDOMIZED CONTROLLED STUDY", "RANDOMISED CONTROLLED TRIAL",
    "RANDOMISED CLINICAL TRIAL", "CLUSTER RANDOMIZED CONTROLLED TRIAL", "OBSERVATIONAL STUDY", "INTERVENTIONAL STUDY", "CLINICAL TRIAL",
    "PILOT STUDY", "CASE-CONTROL", "CROSS-SECTIONAL STUDY", "PROSPECTIVE STUDY", "RETROSPECTIVE STUDY", "COHORT STUDY", "LONGITUDINAL STUDY",
    "CONTROLLED CLINICAL TRIAL", "PHASE 1", "PHASE I", "PHASE 2", "PHASE II", "PHASE 3", "PHASE III", "PHASE 4", "PHASE IV", "OPEN LABEL",
    "OPEN-LABEL", "DOUBLE BLIND", "DOUBLE-BLIND", "SINGLE BLIND", "SINGLE-BLIND", "PLACEBO-CONTROLLED", "PLACEBO CONTROLLED", "CROSSOVER STUDY",
    "CROSS-OVER STUDY", "RANDOMIZED", "RANDOMISED",
]

# Keywords that say nothing of a study.
BLOCKED_KEYWORDS = [
    "randomized controlled trial", "randomized clinical trial", "randomized controlled study", "randomised controlled trial",
    "randomised clinical trial", "cluster randomized controlled trial", "observational study", "interventional study", "clinical trial",
    "pilot study", "case-control", "cross-sectional study", "prospective study", "retrospective study", "cohort study", "longitudinal study",
    "controlled clinical trial", "phase 1", "phase i", "phase 2", "phase ii", "phase 3", "phase iii", "phase 4", "phase iv",
    "healthy volunteer study", "healthy subjects", "healthy volunteers", "treatment", "safety", "efficacy", "outcomes", "patient", "patients",
    "subjects", "human", "participation", "participatory", "measurement", "multicenter", "multicentric", "diagnosis", "diagnoses", "therapy",
    "therapies", "management", "treatment outcome", "treatment protocol", "standard therapy", "best practice", "clinical practice", "pathology",
    "symptom", "symptoms", "complication", "complications", "prognosis", "mortality", "survival", "effectiveness", "evaluation",
]

# Other names of countries.
COUNTRIES = {
    "USA": "United States", "US": "United States", "U.S.": "United States", "U.S.A": "United States", "U.S.A.": "United States",
    "United States of America": "United States", "America": "United States", "UK": "United Kingdom", "U.K.": "United Kingdom",
    "GB": "United Kingdom", "Great Britain": "United Kingdom", "Britain": "United Kingdom", "The Netherlands": "Netherlands",
    "Republic of Korea": "South Korea", "Korea, Republic of": "South Korea",
}

# Codes of states.
STATES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA", "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE",
    "District of Columbia": "DC", "Florida": "FL", "Georgia": "GA", "Hawaii": "HI", "Idaho": "ID", "Illinois": "IL", "Indiana": "IN", "Iowa": "IA",
    "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME", "Maryland": "MD", "Massachusetts": "MA", "Michigan": "MI",
    "Minnesota": "MN", "Mississippi": "MS", "Missouri": "MO", "Montana": "MT", "Nebraska": "NE", "Nevada": "NV", "New Hampshire": "NH",
    "New Jersey": "NJ", "New Mexico": "NM", "New York": "NY", "North Carolina": "NC", "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK",
    "Oregon": "OR", "Pennsylvania": "PA", "Rhode Island": "RI", "South Carolina": "SC", "South Dakota": "SD", "Tennessee": "TN", "Texas": "TX",
    "Utah": "UT", "Vermont": "VT", "Virginia": "VA", "Washington": "WA", "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY",
}

# Specialties and the parts of words that tell of them.
SPECIALTIES = {
    "oncology": ["cancer", "oncolog", "neoplasm", "tumor", "tumour", "carcinoma", "sarcoma", "leukemia", "leukaemia", "lymphoma", "melanoma", "myeloma"],
    "cardiology": ["cardiac", "cardiovascular", "cardiology", "heart", "arrhythmia", "coronary", "myocardial", "angina", "heart failure", "cardio"],
    "neurology": ["neurolog", "neurological", "brain", "stroke", "epilepsy", "seizure", "alzheimer", "parkinson", "multiple sclerosis", "neuropathy", "migraine"],
    "endocrinology": ["diabetes", "thyroid", "endocrin", "metabolic", "hormone", "pituitary", "adrenal"],
    "pulmonology": ["pulmonary", "lung", "respiratory", "asthma", "copd", "bronch", "sleep apnea"],
    "gastroenterology": ["gastro", "liver", "hepatic", "colon", "intestinal", "bowel", "pancreat", "esophag", "hepatitis"],
    "nephrology": ["renal", "kidney", "nephro", "dialysis"],
    "hematology": ["hematolog", "haematolog", "blood", "anemia", "anaemia", "coagulation", "platelet"],
    "psychiatry": ["psychiatr", "depress", "anxiety", "schizophrenia", "bipolar", "psycholog", "mental health", "autism", "adhd"],
    "immunology": ["immunolog", "autoimmune", "lupus", "rheumatoid", "allerg", "asthma", "immune"],
    "infectious_disease": ["infectious", "infection", "hiv", "hepatitis", "covid", "virus", "bacterial", "tuberculosis", "sepsis", "antimicrobial"],
    "orthopedics": ["orthopedic", "orthopaedic", "bone", "joint", "arthritis", "spine", "fracture", "knee", "hip", "shoulder"],
    "dermatology": ["dermatolog", "skin", "psoriasis", "eczema", "acne"],
    "ophthalmology": ["ophthalmolog", "eye", "vision", "retina", "glaucoma", "cataract", "corneal"],
    "urology": ["urolog", "prostate", "bladder", "kidney stone", "urinary"],
    "obstetrics_gynecology": ["obstetric", "pregnancy", "maternal", "fetal", "gyn", "menopaus", "fertility", "endometri"],
    "pediatrics": ["pediatr", "paediatr", "child", "neonatal", "infant", "adolescent"],
    "geriatrics": ["geriatr", "elder", "aging", "ageing", "dementia"],
    "surgery": ["surg", "transplant", "operation", "bypass", "laparoscopic"],
    "radiology": ["radiology", "radiolog", "imaging", "magnetic resonance", "ct scan", "radiation", "ultrasound", "x-ray"],
    "genetics": ["genetic", "gene", "inherited", "chromosom", "genomic", "hereditary"],
    "emergency_medicine": ["emergency", "trauma", "critical care", "resuscitation", "intensive care"],
    "anesthesiology": ["anesthesiolog", "anaesthesiolog", "anesthesia", "anaesthesia", "sedation"],
    "rheumatology": ["rheumatolog", "arthritis", "lupus", "gout", "connective tissue", "fibromyalgia"],
    "otolaryngology": ["otolaryngolog", "ent ", "ear, nose", "sinusitis", "hearing", "auditory", "voice"],
    "dentistry": ["dental", "dentist", "oral", "periodont", "orthodont", "tooth", "gingiv"],
}

# Occupations that are no institutions.
OCCUPATIONS = [
    "professor", "director", "chief", "chair", "chairman", "chairperson", "surgeon", "specialist", "consultant", "resident", "fellow", "nurse",
    "physician", "doctor", "anesthesiologist", "cardiologist", "neurologist", "oncologist", "radiologist", "pathologist", "dermatologist",
    "gastroenterologist", "endocrinologist", "rheumatologist", "nephrologist", "pulmonologist", "hematologist", "ophthalmologist", "urologist",
    "psychiatrist", "pediatrician", "researcher", "scientist", "investigator", "professor emeritus", "associate professor", "assistant professor",
    "clinical professor", "research professor", "adjunct professor", "principle investigator", "principal investigator", "co-investigator",
    "sub-investigator", "study director", "medical director", "clinical director", "research director", "department head", "section head",
    "division chief", "pharmacist", "therapist", "psychologist", "epidemiologist", "biostatistician", "coordinator", "manager", "supervisor",
    "technician", "technologist", "assistant", "associate",
]

# How much of its way a study of a status has gone.
COMPLETION = {
    "COMPLETED": 1.0, "ACTIVE_NOT_RECRUITING": 0.5, "SUSPENDED": 0.3, "ENROLLING_BY_INVITATION": 0.2, "RECRUITING": 0.2, "ACTIVE": 0.2,
    "NOT_YET_RECRUITING": 0.0, "TERMINATED": 0.0, "WITHDRAWN": 0.0,
}
