"""Rule tables of the de-identification policy, as data.

The texts below are fixed values: tags (group and element, 8 hex digits, one a line) and attribute names that results depend on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Elements that get a dummy value by type, sequences among them are deleted.
DUMMY = """
00080014
00080018
00080050
00080054
00080080
00080081
00080090
00080092
00080094
0008010C
0008010D
00080201
00081010
00081048
00081050
00081060
00081070
00081150
00081155
00083010
00089123
00100010
00100020
00100021
00100030
00100032
00100033
00100034
00100035
00101000
00101001
00101005
00101040
00102150
00102152
00102154
00102295
00102299
00120010
00120020
00120030
00120031
00120040
00120042
00120060
00120071
00181000
00181250
00181251
0020000D
0020000E
00200010
00200052
00200200
00201000
00209056
00209164
0032000A
0032000C
00320012
00380008
00380010
00380011
00380300
00380400
00400001
00400010
00400031
00400032
00400033
00400035
00400241
00400242
00401010
00402008
00402009
00402010
00402016
00402017
0040A075
0040A123
0040A124
00700080
00700084
00880130
00880140
04000005
04000010
04000020
04000100
04000115
04000120
04000564
30060024
300600A6
300600C2
300A0182
40080040
4008010A
4008010C
40080114
40080119
4008011A
40080200
40080210
40080212
"""

# Order-entry elements, deleted at any depth up to 8.
ORDER_ENTRY = """
00080051 IssuerOfAccessionNumberSequence
0032000A StudyStatusID
0032000C StudyPriorityID
00320012 StudyIDIssuer
00321020 ScheduledStudyLocation
00321021 ScheduledStudyLocationAETitle
00321030 ReasonForStudy
00321031 RequestingPhysicianIdentificationSequence
00321032 RequestingPhysician
00321033 RequestingService
00321034 RequestingServiceCodeSequence
00321040 StudyArrivalDate
00321041 StudyArrivalTime
00321050 StudyCompletionDate
00321051 StudyCompletionTime
00321055 StudyComponentStatusID
00321060 RequestedProcedureDescription
00321064 RequestedProcedureCodeSequence
00321070 RequestedContrastAgent
00324000 StudyComments
00380004 ReferencedPatientAliasSequence
0038001A ScheduledAdmissionDate
0038001B ScheduledAdmissionTime
0038001C ScheduledDischargeDate
0038001D ScheduledDischargeTime
0038001E ScheduledPatientInstitutionResidence
00380060 ServiceEpisodeID
00380062 ServiceEpisodeDescription
00380064 IssuerOfServiceEpisodeID
00380100 PertinentDocumentsSequence
0038011A RouteOfAdmissions
00384000 VisitComments
00400001 ScheduledStationAETitle
00400010 ScheduledStationName
00400011 ScheduledProcedureStepLocation
00400012 PreMedication
00401001 RequestedProcedureID
00401002 ReasonForRequestedProcedure
00401004 PatientTransportArrangements
00401005 RequestedProcedureLocation
00401010 NamesOfIntendedRecipientsOfResults
00401011 IntendedRecipientsOfResultsIdentificationSequence
00401101 PersonIdentificationCodeSequence
00401102 PersonAddress
00401103 PersonTelephoneNumbers
00401400 RequestedProcedureComments
00402008 OrderEnteredBy
00402009 OrderEntererLocation
00402010 OrderCallbackPhoneNumber
00402016 PlacerOrderNumberImagingServiceRequest
00402017 FillerOrderNumberImagingServiceRequest
00403001 ConfidentialityConstraint
"""

# Further identifiers, deleted at any depth up to 8.
EXTRA = """
00101060 PatientMotherBirthName
00102180 Occupation
001021A0 SmokingStatus
001021D0 LastMenstrualDate
001021F0 PatientReligiousPreference
00400241 PerformedStationAETitle
00400243 PerformedLocation
00400251 PerformedProcedureStepEndTime
00400253 PerformedProcedureStepID
00400555 AcquisitionContextSequence
"""
ETHNIC_GROUP = "00102160"

# Free-text descriptors, blanked; sequences among them are deleted.
DESCRIPTORS = """
00080080
00080081
00081030
0008103E
00081040
00081080
00081084
00082111
00084000
00102000
00102110
001021B0
00104000
00181030
00181400
00184000
00189424
00204000
00284000
00321030
00321060
00324000
00380040
00380500
00384000
00400007
00400254
00400280
00401400
00402001
00402400
00403001
4008011A
40080300
"""

# Names of dates and times in the log of changed tags.
DATE_NAMES = """
00080020 StudyDate
00080021 SeriesDate
00080022 AcquisitionDate
00080023 ContentDate
00080024 OverlayDate
00080025 CurveDate
0008002A AcquisitionDateTime
00080030 StudyTime
00080031 SeriesTime
00080032 AcquisitionTime
00080033 ContentTime
00100030 PatientBirthDate
00100032 PatientBirthTime
001021D0 LastMenstrualDate
00181012 DateOfSecondaryCapture
00181014 TimeOfSecondaryCapture
00181200 DateOfLastCalibration
00181201 TimeOfLastCalibration
00321000 ScheduledStudyStartDate
00321010 ScheduledStudyStopDate
00321040 StudyArrivalDate
00321050 StudyCompletionDate
00380020 AdmittingDate
00380021 AdmittingTime
00380030 DischargeDate
00400002 ScheduledProcedureStepStartDate
00400003 ScheduledProcedureStepStartTime
00400004 ScheduledProcedureStepEndDate
00400005 ScheduledProcedureStepEndTime
00400244 PerformedProcedureStepStartDate
00400245 PerformedProcedureStepStartTime
00400250 PerformedProcedureStepEndDate
00400251 PerformedProcedureStepEndTime
00402004 IssueDateOfImagingServiceRequest
0040A030 VerificationDateTime
0040A120 DateTime
0040A121 Date
0040A122 Time
"""

# Elements whose value must be empty or a placeholder.
MUST_BE_EMPTY = """
00080050 AccessionNumber
00080080 InstitutionName
00080081 InstitutionAddress
00080090 ReferringPhysicianName
00081048 PhysiciansOfRecord
00081050 PerformingPhysicianName
00081070 OperatorsName
00100010 PatientName
00101000 OtherPatientIDs
00101001 OtherPatientNames
00101040 PatientAddress
00102154 PatientTelephoneNumbers
00380300 CurrentPatientLocation
"""

# File meta elements that identify the writing site.
FILE_META = """
00020013 ImplementationVersionName
00020016 SourceApplicationEntityTitle
00020017 SendingApplicationEntityTitle
00020018 ReceivingApplicationEntityTitle
00020100 PrivateInformationCreatorUID
00020102 PrivateInformation
"""

# UIDs of the standard itself, references that need a value, the icon sequence.
NEVER_REMAPPED = ["00020002", "00020010", "00080016", "00081150"]
TYPE1_REFERENCES = {"00081150": "ReferencedSOPClassUID", "00081155": "ReferencedSOPInstanceUID"}
ICON_SEQUENCE = "00880200"

# Placeholders (lower case) that are no findings.
PLACEHOLDERS = ["anonymous", "anonymous^anonymous", "processed for anonymization", "anonymized", "unknown", "none", "removed", "000y", "0", "000000", "000000.000000", "--------"]

# The options of the confidentiality profile.
PROFILE_CODES = [
    ("113100", "Basic Application Confidentiality Profile"),
    ("113101", "Clean Pixel Data Option"),
    ("113102", "Clean Recognizable Visual Features Option"),
    ("113105", "Clean Descriptors Option"),
    ("113108", "Retain Patient Characteristics Option"),
]

# Secondary-capture classes; words of the cohort predicate.
SECONDARY_CAPTURE = ["1.2.840.10008.5.1.4.1.1.7", "1.2.840.10008.5.1.4.1.1.7.1", "1.2.840.10008.5.1.4.1.1.7.2", "1.2.840.10008.5.1.4.1.1.7.3", "1.2.840.10008.5.1.4.1.1.7.4"]
MODALITIES = ["ct", "computedtomography", "ctprotocal"]
IMAGE_TYPES = ["original", "primary", "axial"]
BODY_PARTS = ["head", "brain", "skull"]
ANGIO = ["angio", "cta", "perfusion"]

# Sequences that announce earlier identities: named by the policy's text, deleted in hardened mode.
HARDENED_SEQUENCES = ["04000500", "04000550", "04000561", "FFFAFFFA"]


def named(text: str) -> dict[str, str]:
    return dict(line.split() for line in text.split("\n") if line)


DUMMY_TAGS, DESCRIPTOR_TAGS = DUMMY.split(), DESCRIPTORS.split()
ORDER_ENTRY_TAGS, EXTRA_TAGS, FILE_META_TAGS = named(ORDER_ENTRY), named(EXTRA), named(FILE_META)
DATE_TAGS, EMPTY_TAGS = named(DATE_NAMES), named(MUST_BE_EMPTY)
#: Union of the two deletion tables.
ABSENT_TAGS = ORDER_ENTRY_TAGS | EXTRA_TAGS


def policy_rules(spark: SparkSession) -> DataFrame:
    """tag, action, name of all tables, for joins and reports."""
    rows = [(t, "dummy", None) for t in DUMMY_TAGS] + [(t, "blank", None) for t in DESCRIPTOR_TAGS]
    for action, table in (("delete_order_entry", ORDER_ENTRY_TAGS), ("delete_extra", EXTRA_TAGS), ("must_be_absent", ABSENT_TAGS), ("must_be_empty", EMPTY_TAGS), ("delete_file_meta", FILE_META_TAGS), ("date_name", DATE_TAGS)):
        rows += [(t, action, n) for t, n in table.items()]
    return spark.createDataFrame(rows, "tag string, action string, name string")
