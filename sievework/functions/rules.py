"""Rule tables: invented, neutral term lists of the kinds a curation run needs.

Every operator takes its rules as a parameter; these are the defaults for the test data.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rules:
    """Terms of one curation policy; matching is noted beside each list."""

    gate: tuple[str, ...] = ("engineer", "developer", "programmer", "researcher", "מהנדס", "מפתח", "מתכנת", "חוקר", "ingeni", "entwickler", "développeu")  # substring
    gate_words: tuple[str, ...] = ("sw", "fw", "qa", "sre", "ml")  # whole word
    senior: tuple[str, ...] = ("senior", "lead", "principal", "בכיר", "ראשי", "מוביל", "ראש צוות")  # substring
    senior_words: tuple[str, ...] = ("sr", "staff", "head")  # whole word
    junior: tuple[str, ...] = ("junior", "entry level", "graduate", "מתחיל")  # substring
    student_words: tuple[str, ...] = ("student", "students", "intern", "interns", "trainee", "werkstudent")  # whole word
    student_he: tuple[str, ...] = ("סטודנט",)  # substring
    student_start: tuple[str, ...] = ("מתמחה",)  # start of the title
    experienced: tuple[str, ...] = ("experienced", "expert", "seasoned")  # whole word
    experienced_he: tuple[str, ...] = ("מנוסה", "מנוסים", "מומחה")  # substring
    skip_words: tuple[str, ...] = ("verilog", "uvm", "vhdl")  # whole word, in the title
    #: a title of these is a skip where the text speaks of those
    guarded: tuple[str, ...] = ("verification", "v&v", "ורפיקציה")  # substring, in the title
    guards: tuple[str, ...] = ("uvm", "testbench", "verilog", "rtl")  # whole word, in the text
    manual: tuple[str, ...] = ("manual", "ידני")  # substring, in the title
    tester: tuple[str, ...] = ("qa", "tester", "test", "בדיקות", "בודק")  # whole word, in the title
    automated: tuple[str, ...] = ("automation", "automated", "אוטומציה")  # substring, in the title
    automation_tools: tuple[str, ...] = ("pytest", "selenium", "playwright", "jenkins", "python", "robot framework")  # substring, in the text
    min_tools: int = 2
    industrial: tuple[str, ...] = ("plc", "scada", "hmi", "בקרה")  # whole word, in the title
    bench_test: tuple[str, ...] = ("pcb", "rf test", "electrical test", "lab technician")  # substring, in the title
    training: tuple[str, ...] = ("bootcamp", "academy", "training course", "קורס", "הכשרה")  # substring, in the title
    gap_terms: tuple[str, ...] = ("graphics", "compiler", "security")  # term, in the title
    core_terms: tuple[str, ...] = ("embedded", "firmware", "integration")  # term, in the head of the title
    signals: tuple[str, ...] = ("python", "linux", "docker", "kubernetes", "git", "c++", "rust", "java", "sql", "spark")  # substring, in the text
    min_signals: int = 3
    qa_words: tuple[str, ...] = ("qa", "test", "automation")  # whole word, in the title
    drop_regions: tuple[str, ...] = ("South", "Jerusalem", "Abroad")
    page_regions: tuple[str, ...] = ("North", "Unknown")
    giants: tuple[str, ...] = ("merrabria", "sargaric", "zelsozulox", "mavdumovorn", "nimpeton")  # company
    referral: tuple[str, ...] = ("orzurel", "holnofibria")  # company
    student_level_sources: tuple[str, ...] = ("hirevane", "tafkidim", "misrot")
    junior_levels: tuple[str, ...] = ("junior", "entry")
    #: words of a company or title that tell nothing about which one it is
    empty_words: tuple[str, ...] = ("a", "an", "the", "for", "of", "in", "at", "and", "ltd", "inc", "gmbh", "company", "senior", "junior")
    #: names that end in signs, and how they are spelled in identity keys
    spelled_signs: tuple[tuple[str, str], ...] = (("c++", "cpp"), ("c#", "csharp"), ("f#", "fsharp"), (".net", "dotnet"))
    #: words that may stand behind a company's name run together with it, and how long such a name must be
    corporate: tuple[str, ...] = ("company", "gmbh", "group", "holdings", "inc", "labs", "ltd", "logistics", "networks", "optics", "payments", "photonics", "robotics", "semicon", "analytics", "health")
    glued_letters: int = 6
    generic_places: tuple[str, ...] = ("israel", "ישראל", "remote", "hybrid", "nationwide", "multiple sites", "various")
    ways_of_working: tuple[str, ...] = ("hybrid", "remote", "onsite", "site", "on")
    boards: tuple[str, ...] = ("hirevane.example", "jobmarrow.test", "worklist.example", "roleboard.test", "tafkidim.test", "misrot.example", "deskfinder.test")
    #: category -> words; the earliest of the best wins
    categories: tuple[tuple[str, tuple[str, ...]], ...] = field(
        default=(
            ("embedded", ("firmware", "rtos", "can bus", "embedded", "verilog")),
            ("cloud", ("kubernetes", "docker", "terraform", "cloud-hosted", "distributed")),
            ("data", ("spark", "kafka", "sql", "ingestion", "postgres")),
            ("web", ("react", "node", "typescript", "frontend", "customer-facing")),
        )
    )
    #: roles of the trade beyond the gate, what rules them out, and titles that are read as another
    digest_roles: tuple[str, ...] = ("engineer", "analyst", "tester", "architect", "researcher")  # whole word
    digest_roles_he: tuple[str, ...] = ("מהנדס", "אנליסט", "בודק", "חוקר")  # substring
    digest_skip: tuple[str, ...] = ("sales", "manager", "technician", "mechanical", "electrical", "civil", "process", "product engineer")  # whole word
    digest_reads: tuple[tuple[str, str], ...] = (("technical product engineer", "technical product role"),)
    #: decision -> reason given
    reasons: dict[str, str] = field(
        default_factory=lambda: {
            "bench": "not-software-test", "manual": "manual-test", "industrial": "industrial", "training": "training", "foundation": "foundation", "student": "student", "years": "junior-title-many-years", "experienced": "experienced",
            "known_senior": "senior-at-known", "known_three": "three-years-at-known", "known": "open-at-known", "junior": "junior", "senior": "senior", "three": "three-years", "open": "open", "learn": "junior-with-gap", "gap": "gap",
        }
    )
    #: vocabulary of tags in the order of the output
    vocabulary: tuple[str, ...] = ("python", "java", "c++", "c#", "go", "rust", "sql", "kafka", "spark", "docker", "kubernetes", "linux", "git", "react", "node", "verilog", "uvm", "rtos")
    #: ordered company rules: label -> names; the first that matches wins
    company_rules: tuple[tuple[str, tuple[str, ...]], ...] = (("large", ("merrabria", "mavdumovorn")), ("hardware", ("sargaric", "orzurel")), ("broker", ("zelsozulox",)))


RULES = Rules()
