"""Explicit schemas of documents, records, tables and queries."""

from __future__ import annotations

DOCUMENT = (
    "source string, external_id string, document_type string, raw_text string, "
    "payload string, metadata map<string,string>, file string, seq long"
)

EXPERIENCE = (
    "struct<company:string,title:string,start_date:string,end_date:string,"
    "description:string,domains:array<string>,technologies:array<string>>"
)
EDUCATION = "struct<university:string,country:string,degree:string,field_of_study:string>"
PROJECT = "struct<name:string,description:string,technologies:array<string>,domains:array<string>>"

# A canonical record without its provenance; also what an extraction provider returns.
EXTRACTED = (
    "struct<full_name:string,location:string,country:string,current_title:string,"
    "years_experience:double,age:int,summary:string,"
    f"experience:array<{EXPERIENCE}>,skills:array<string>,technologies:array<string>,"
    f"education:array<{EDUCATION}>,projects:array<{PROJECT}>,domains:array<string>>"
)

ERROR = "struct<error_type:string,message:string>"

TABLES = {
    "people": (
        "person_id string, source string, source_id string, full_name string, "
        "normalized_identity string, location string, country string, current_title string, "
        "years_experience double, age int, summary string"
    ),
    "companies": "company_id string, name string, normalized_name string, country string",
    "skills": "skill_id string, name string, normalized_name string",
    "skill_aliases": "alias string, skill_id string",
    "technologies": "technology_id string, name string, normalized_name string",
    "projects": "project_id string, name string, normalized_name string, description string",
    "universities": "university_id string, name string, normalized_name string, country string",
    "domains": "domain_id string, name string, normalized_name string",
    "person_companies": "person_id string, company_id string",
    "person_skills": "person_id string, skill_id string",
    "person_technologies": "person_id string, technology_id string",
    "person_projects": "person_id string, project_id string",
    "person_universities": "person_id string, university_id string",
    "person_domains": "person_id string, domain_id string",
    "company_domains": "company_id string, domain_id string",
    "project_technologies": "project_id string, technology_id string",
    "project_domains": "project_id string, domain_id string",
    "raw_documents": (
        "document_id string, source string, external_id string, document_type string, "
        "raw_text string, metadata map<string,string>, checksum string, person_id string, seq long"
    ),
    "document_chunks": (
        "chunk_id string, document_id string, person_id string, section string, ordinal int, "
        "content string, content_checksum string, metadata map<string,string>, "
        "embedding array<float>, embedding_model string"
    ),
    "candidate_inferences": (
        "person_id string, inference_type string, claim string, peer_id string, "
        "confidence double, reason string, evidence_ids array<string>, status string"
    ),
    "ingest_runs": (
        "run_id string, status string, options map<string,string>, "
        "report map<string,long>, error string, created_at timestamp"
    ),
}

# One row per search; lists may be null, which means empty.
QUERY = (
    "query_id string, text string, role string, seniority string, country string, city string, "
    "cities array<string>, min_years_experience double, min_age int, max_age int, "
    "required_skills array<string>, required_technologies array<string>, "
    "required_domains array<string>, preferred_skills array<string>, "
    "preferred_technologies array<string>, preferred_domains array<string>, "
    "companies array<string>, projects array<string>, semantic_query string"
)

LIST_FIELDS = (
    "cities",
    "required_skills",
    "required_technologies",
    "required_domains",
    "preferred_skills",
    "preferred_technologies",
    "preferred_domains",
    "companies",
    "projects",
)

EVIDENCE = (
    "query_id string, person_id string, position int, chunk_id string, source string, "
    "content string, score double"
)
