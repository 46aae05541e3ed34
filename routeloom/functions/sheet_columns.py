"""Columns of the review sheets. Other tools read these sheets by name and order."""

IDS = ["sample_id", "cell_sample_id", "cellRouteOrdinal", "route_id", "evidence_id"]

CONTEXT = [
    "repository",
    "commit",
    "httpMethod",
    "normalizedPath",
    "path",
    "sourceKind",
    "file",
    "lineStart",
    "symbol",
    "responseCodes",
    "operationSummary",
    "operationDescription",
    "responseSemanticsEvidence",
]

WORKFLOW = [
    "label_taxonomy",
    "allowed_final_labels",
    "labelerA_label",
    "labelerA_rationale",
    "labelerA_confidence",
    "labelerB_label",
    "labelerB_rationale",
    "labelerB_confidence",
    "agreement",
    "final_label",
    "adjudicated",
    "adjudicator_rationale",
]

PILOT = [
    "sample_id",
    "httpMethod",
    "normalizedPath",
    "path",
    "responseCodes",
    "sourceKind",
    "file",
    "symbol",
    "operationSummary",
    "operationDescription",
]

CELL = [
    "family_id",
    "repository",
    "pattern",
    "cellRouteCount",
    "linkageBucket",
    "deleteOperationResourceBucket",
    "populationFamilyMemberships",
    "patternSampleSize",
    "patternSamplingFraction",
    "analysisWeight",
    "familyPatternHasSameResourceLinked",
    "familyPatternHasOperationTarget",
    "familyPatternHasDomainTransitionRisk",
    "familyPatternCancellationEvidence",
    "strictFamilyPatternMemberships",
    "strictFamilyApproxInclusionProbability",
    "strictFamilyApproxAnalysisWeight",
]

ROUTE = [
    "httpMethod",
    "normalizedPath",
    "path",
    "sourceKind",
    "file",
    "lineStart",
    "commit",
    "symbol",
    "responseCodes",
    "confidence",
    "cancelTargetPath",
    "routeLevelOperationLinked",
    "operationTarget",
    "domainTransitionRisk",
]

TEXTS = ["adjacentOperationEvidence", "terminalStateEvidence", "responseSemanticsEvidence"]
REVIEW = ["primaryLabel", "secondaryFlags", "reviewerConfidence", "rationale"]
REVIEWER = ["reviewer", "adjudicatedLabel"]
UNIT = ["samplingUnit", "estimationPopulation"]

REPRESENTATIVE_SHEET = ["sample_id", "route_id", "evidence_id", *UNIT, *CELL, *ROUTE, *REVIEW, *TEXTS, *REVIEWER]
CELL_ROUTE_SHEET = [*IDS, *UNIT, *CELL, *ROUTE, *REVIEW, *TEXTS, *REVIEWER]
ROUTE_SHEET = [
    "sample_id", "route_id", "evidence_id", *UNIT,
    "routeStratum", "routeFramePopulationRecords", "routeStratumSampleSize", "routeStratumSamplingFraction", "routeStratumAnalysisWeight",
    "family_id", "repository", "pattern", "deleteOperationResourceBucket", *ROUTE, *TEXTS, *REVIEW, *REVIEWER,
]
FAMILY_SHEET = [
    "sample_id", "route_id", "evidence_id", *UNIT, "family_id", "repository", "pattern", "linkageBucket", "deleteOperationResourceBucket",
    "populationStrictFamilies", "strictFamilySampleSize", "strictFamilySamplingFraction", "strictFamilyAnalysisWeight", "strictFamilyPatternMemberships",
    "strictFamilyHasSameResourceLinked", "strictFamilyHasOperationTarget", "strictFamilyHasDomainTransitionRisk", "strictFamilyCancellationEvidence",
    *ROUTE, *REVIEW, *TEXTS, *REVIEWER,
]

DELETE_TAXONOMY, OTHER_TAXONOMY = "delete-operation-resource", "operation-vs-domain"
DELETE_LABELS = "cancellation;deletion-or-archival;ambiguous"
OTHER_LABELS = "operation-cancellation;domain-state-transition;ambiguous"
