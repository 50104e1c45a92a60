"""Declared schemas, as DDL; sources are never inferred."""

from __future__ import annotations

#: A page of the registry's nested documents.
REGISTRY_PAGE = """
studies array<struct<protocolSection: struct<
  identificationModule: struct<nctId: string, briefTitle: string, officialTitle: string, orgStudyIdInfo: struct<id: string>>,
  statusModule: struct<overallStatus: string, startDateStruct: struct<date: string>, completionDateStruct: struct<date: string>, studyFirstPostDateStruct: struct<date: string>,
    lastUpdatePostDateStruct: struct<date: string>>,
  sponsorCollaboratorsModule: struct<leadSponsor: struct<name: string>, collaborators: array<struct<name: string>>>,
  descriptionModule: struct<briefSummary: string>,
  conditionsModule: struct<conditions: array<string>, keywords: array<string>>,
  designModule: struct<studyType: string, phases: array<string>, designInfo: struct<allocation: string, interventionModel: string, primaryPurpose: string, masking: string,
    maskingInfo: struct<masking: string>>, enrollmentInfo: struct<count: int>>,
  armsInterventionsModule: struct<armGroups: array<struct<label: string, type: string, description: string>>, interventions: array<struct<type: string, name: string, description: string>>>,
  outcomesModule: struct<primaryOutcomes: array<struct<measure: string, description: string, timeFrame: string>>, secondaryOutcomes: array<struct<measure: string, description: string, timeFrame: string>>>,
  eligibilityModule: struct<eligibilityCriteria: string, sex: string, minimumAge: string, maximumAge: string, healthyVolunteers: string>,
  contactsLocationsModule: struct<overallOfficials: array<struct<name: string, affiliation: string, role: string>>, locations: array<struct<facility: string, city: string, state: string, country: string>>>,
  referencesModule: struct<references: array<struct<pmid: string, type: string, citation: string>>>>>>,
nextPageToken string
"""

#: A page of providers by name or organisation.
PROVIDERS = """
results array<struct<number: string, basic: struct<first_name: string, last_name: string, middle_name: string, credential: string, organization_name: string, status: string>,
  addresses: array<struct<address_purpose: string, city: string, state: string>>, taxonomies: array<struct<`desc`: string, primary: boolean, state: string, license: string>>,
  identifiers: array<struct<identifier: string, identifier_type: string, state: string>>, other_names: array<struct<first_name: string, last_name: string>>>>
"""

#: Yearly use of a provider; numbers may come as text.
UTILISATION = "Rndrng_NPI string, Rndrng_Prvdr_Type string, Tot_Benes string, Tot_Srvcs string, Tot_Mdcr_Pymt_Amt string, Bene_Avg_Risk_Scre string"

#: A page of payments; amounts and dates come as text.
PAYMENTS = """
results array<struct<covered_recipient_npi: string, total_amount_of_payment_usdollars: string, date_of_payment: string, applicable_manufacturer_or_applicable_gpo_making_payment_name: string,
  nature_of_payment_or_transfer_of_value: string, name_of_study: string, program_year: string, record_id: string>>, count long
"""

#: Authors found by a search.
AUTHORS = "query string, data array<struct<authorId: string, name: string, paperCount: int, citationCount: int, hIndex: int>>"

#: Researchers found by a search.
RESEARCHERS = "query string, result array<struct<`orcid-identifier`: struct<path: string>>>"

#: The vocabulary as parallel arrays.
VOCABULARY = "names array<string>, cuis array<string>, tree_numbers array<array<string>>, categories array<string>"

#: A publication in XML.
ARTICLE = """
MedlineCitation struct<PMID: string, Article: struct<ArticleTitle: string, Journal: struct<Title: string, JournalIssue: struct<PubDate: struct<Year: string, Month: string, Day: string>>>,
    Abstract: struct<AbstractText: array<string>>, AuthorList: struct<Author: array<struct<LastName: string, ForeName: string, Identifier: string>>>,
    PublicationTypeList: struct<PublicationType: array<string>>>,
  MeshHeadingList: struct<MeshHeading: array<struct<DescriptorName: struct<_VALUE: string, _UI: string>>>>>
"""

#: Events of the work queue.
QUEUE_EVENT = """id long, event_type string, status string, data string, created_at timestamp, claimed_at timestamp, completed_at timestamp, last_error_at timestamp,
progress_at timestamp, retry_count int, processed int, total int"""

#: A descriptor of the vocabulary in XML.
DESCRIPTOR_RECORD = """
DescriptorUI string, DescriptorName struct<String: string>, TreeNumberList struct<TreeNumber: array<string>>,
ConceptList struct<Concept: array<struct<ConceptName: struct<String: string>, ConceptPreferredNameYN: string, TermList: struct<Term: array<struct<String: string>>>>>>
"""
