"""Pattern tables of the text operators."""

from __future__ import annotations

# Signal patterns in order of search (type, direction, confidence, pattern).
SIGNAL_PATTERNS = (
    ("capex_increase", "positive", 0.85, r"\b(?:capital expenditure|capex|capital spending)\b.{0,60}(?:increas|rais|expan|doubl|grow)"),
    ("capex_increase", "positive", 0.85, r"\b(?:increas|rais|expan|doubl)\b.{0,60}(?:capital expenditure|capex|capital spending)"),
    ("capex_increase", "positive", 0.82, r"\binvest(?:ing|ment)?.{0,40}(?:\$\s?\d+(?:\.\d+)?\s*(?:billion|million|B|M\b)|(?:Rs\.?\s*|INR\s*|₹\s*)\d[\d,]*\s*(?:crores?|lakhs?|Crs?\b|cr\b))\b"),
    ("capex_increase", "positive", 0.82, r"(?:Rs\.?\s*|INR\s*|₹\s*)\d[\d,]*(?:\.\d+)?\s*(?:crores?|lakhs?|Crs?\b|cr\b).{0,60}(?:invest|capex|plant|expand|facilit|manufactur|greenfield|brownfield)"),
    ("capex_increase", "positive", 0.85, r"\b(?:greenfield|brownfield)\b.{0,60}(?:plant|facilit|project|unit|manufactur|invest)"),
    ("capex_increase", "positive", 0.83, r"\b(?:new\s+(?:plant|facilit|manufactur|unit|line|capacity)|capacity\s+(?:addition|expansion|augment|enhance|creat|build))\b"),
    ("capex_increase", "positive", 0.82, r"\b(?:set(?:ting)?\s+up|commission(?:ing)?|establish(?:ing)?)\b.{0,40}(?:plant|unit|facilit|manufactur|capacity|production)"),
    ("capex_decrease", "negative", 0.80, r"\b(?:capital expenditure|capex)\b.{0,60}(?:decreas|reduc|cut|lower|trim)"),
    ("capex_increase", "positive", 0.78, r"\b(?:QIP|qualified\s+institutional\s+placement|preferential\s+allotment)\b.{0,80}(?:expand|capex|manufactur|plant|facilit|greenfield|brownfield|capacity)"),
    ("demand_surge", "positive", 0.92, r"\b(?:demand|orders?|customer(?:s)?|request(?:s)?)\b.{0,80}(?:exceed|outstrip|outpac|overwhelm|surpass).{0,50}(?:supply|capacity|production|output)"),
    ("supply_bottleneck", "negative", 0.92, r"\b(?:can(?:not|'t)\s+(?:meet|keep\s+up\s+with|satisfy|fulfill)|unable\s+to\s+(?:meet|satisfy|fulfill)).{0,60}(?:demand|orders?|request|need)"),
    ("supply_bottleneck", "negative", 0.90, r"\b(?:sold\s+out|fully\s+booked|allocation.{0,30}(?:limit|constrain|scarc)|lead.?time(?:s)?\s+(?:extend|lengthen|stretch|grow|increas))"),
    ("supply_bottleneck", "negative", 0.88, r"\bwaiting\s+(?:list|time|period).{0,40}(?:grow|increas|lengthen|extend)"),
    ("demand_surge", "positive", 0.85, r"\b(?:demand|orders?|backlog|pipeline)\b.{0,60}(?:surge|boom|strong(?:er)?|record|accelerat|exceed|outpac|robust|exceptional)"),
    ("demand_surge", "positive", 0.85, r"\brecord\b.{0,40}(?:demand|orders?|revenue|sales|bookings?|backlog)"),
    ("demand_surge", "positive", 0.88, r"\b(?:demand|orders?|bookings?)\b.{0,30}(?:up|grew|grow|increas).{0,20}\d+\s*%"),
    ("demand_surge", "positive", 0.80, r"\bdemand\s+(?:outlook|trend|environment)\b.{0,40}(?:positive|strong|favor|improv|robust)"),
    ("demand_surge", "positive", 0.88, r"\b(?:bagg(?:ing|ed)|receiv(?:ing|ed)|secur(?:ing|ed)|award(?:ed)?|win(?:ning|s)?|won)\b.{0,60}(?:order|contract|project|work\s+order|purchase\s+order)"),
    ("demand_surge", "positive", 0.85, r"\bnew\s+order(?:s)?\b.{0,60}(?:receiv|secur|bagg|win|award|obtain)"),
    ("demand_surge", "positive", 0.85, r"\b(?:order|contract|project)\b.{0,40}(?:(?:Rs\.?\s*|INR\s*|₹\s*)\d[\d,]*\s*(?:crores?|lakhs?|Crs?\b)|\$\s*\d+(?:\.\d+)?(?:\s*(?:billion|million|B|M\b))?)"),
    ("demand_surge", "positive", 0.80, r"\b(?:PAT|profit\s+after\s+tax|net\s+profit|revenue|turnover|sales|earnings|EPS)\b.{0,40}(?:grew|increas|up|rise|rose|surged|jumped).{0,20}\d+\s*%"),
    ("demand_surge", "positive", 0.75, r"\bgrew?\b.{0,30}\d+\s*%\b.{0,30}(?:YOY|year.on.year|YTD|QOQ|quarter)"),
    ("demand_slowdown", "negative", 0.80, r"\b(?:demand|orders?)\b.{0,60}(?:weak|soft|declin|slow|disappoint|compress|soften|muted)"),
    ("demand_slowdown", "negative", 0.80, r"\b(?:PAT|profit\s+after\s+tax|net\s+profit|revenue|turnover|sales|earnings|EPS)\b.{0,40}(?:declin|decreas|fell|drop|down|lower).{0,20}\d+\s*%"),
    ("demand_slowdown", "negative", 0.75, r"\bdeclin\w*\b.{0,30}\d+\s*%\b.{0,30}(?:YOY|year.on.year|QOQ|quarter)"),
    ("supply_bottleneck", "negative", 0.87, r"\b(?:supply\s+(?:chain\s+)?(?:shortage|constraint|crunch|tightness|disruption|bottleneck)|capacity\s+(?:constraint|crunch|limit|shortfall|tighten)|component\s+(?:shortage|scarcity|crunch)|material\s+(?:shortage|scarcity|constraint))"),
    ("supply_bottleneck", "negative", 0.83, r"\b(?:supply\s+chain)\b.{0,60}(?:tighten|strain|disrupt|challeng|stress|squeez)"),
    ("supply_bottleneck", "negative", 0.88, r"\b(?:bottleneck|constrain|shortage|scarcity|crunch)\b.{0,60}(?:material|component|chip|wafer|lith|cobalt|copper|power|grid|labor|talent|bandwidth|rack|gpu)"),
    ("supply_bottleneck", "negative", 0.82, r"\b(?:limited\s+(?:supply|availability|capacity)|supply\s+(?:limited|constrained|tight|insufficient))"),
    ("supply_easing", "positive", 0.75, r"\b(?:supply\s+chain)\b.{0,60}(?:normal|ease|improv|resol|recover|stabiliz)"),
    ("supply_easing", "positive", 0.75, r"\b(?:inventory\s+(?:normal|recover|stabiliz|build)|supply\s+(?:recover|improv|ease|increase|catch\s+up))"),
    ("inventory_buildup", "neutral", 0.70, r"\b(?:inventory).{0,40}(?:build|accumulat|higher|days\s+on\s+hand|increas)"),
    ("inventory_drawdown", "neutral", 0.70, r"\b(?:inventory).{0,40}(?:draw|declin|reduc|normaliz|burn|digest|thin)"),
    ("strategic_pivot", "neutral", 0.80, r"\b(?:strategic\s+pivot|shift\s+strateg|new\s+(?:strategic\s+)?direction|strategic\s+review|business\s+transformation)\b"),
    ("strategic_pivot", "neutral", 0.78, r"\b(?:pivot(?:ing|ed)?|repositioning)\b.{0,60}(?:strateg|business|model|focus|portfol)"),
    ("partnership_formed", "positive", 0.80, r"\b(?:partner(?:ship)?|joint\s+venture|collaborat|alliance).{0,40}(?:announc|form|sign|enter)"),
    ("acquisition_intent", "positive", 0.80, r"\b(?:acqui(?:sition|re|ring)|merger(?!\s+of\s+equals)|takeover|buyout)\b.{0,80}(?:agree|announc|approv|complet|clos|sign|propos|plan|intend|contemplat|pursu)|(?:agree|announc|approv|complet|clos|sign|propos|plan|intend|contemplat|pursu).{0,80}\b(?:acqui(?:sition|re|ring)|merger|takeover|buyout)\b"),
    ("technology_adoption", "positive", 0.85, r"\b(?:deploy(?:ing|ment)?|adopt(?:ing)?|implement(?:ing)?|integrat(?:ing)?).{0,40}(?:AI|artificial\s+intelligence|machine\s+learning|LLM|GPU|cloud|automation|robotics)"),
    ("technology_disruption", "negative", 0.75, r"\b(?:replac|displac|disrupt|obsolete|legacy).{0,40}(?:technolog|platform|product|system)"),
    ("competition_threat", "negative", 0.75, r"\b(?:compet(?:ition|itor|itive)|market\s+share.{0,30}(?:loss|declin|gain|erode))"),
    ("market_entry", "positive", 0.70, r"\b(?:enter(?:ing)?|launch(?:ing)?).{0,30}(?:market|segment|geography)"),
    ("regulatory_tailwind", "positive", 0.80, r"\b(?:regulat(?:ion|ory)).{0,60}(?:favorable|tailwind|benefit|support|approv)"),
    ("regulatory_headwind", "negative", 0.80, r"\b(?:regulat(?:ion|ory)).{0,60}(?:headwind|restrict|penalt|fine|challeng|concern)"),
    ("regulatory_tailwind", "positive", 0.85, r"\b(?:FDA|EPA|FTC|CFPB|CFTC|antitrust).{0,40}(?:approv|clear|pass|grant)"),
    ("regulatory_headwind", "negative", 0.85, r"\b(?:FDA|EPA|FTC|CFPB).{0,40}(?:investigat|reject|fine|penalt|block)"),
    ("regulatory_tailwind", "positive", 0.85, r"\b(?:SEBI|RBI|Reserve\s+Bank|NCLT|NCLAT|CCI|DPIIT|MoF|Ministry\s+of\s+Finance)\b.{0,60}(?:approv|clear|allow|permit|grant|nod|green.?light|sanction)"),
    ("regulatory_headwind", "negative", 0.85, r"\b(?:SEBI|RBI|NCLT|CCI)\b.{0,60}(?:reject|fine|penalt|investigat|suspen|restrain|block|violat|impos\w*\s+(?:penalty|fine)|show.cause|adverse\s+order|enforcement\s+action)"),
    ("hiring_surge", "positive", 0.75, r"\b(?:hir(?:ing|e)|headcount|workforce|recruit).{0,40}(?:expan|increas|surge|ramp|significan|accelerat)"),
    ("hiring_freeze", "negative", 0.80, r"\b(?:layoff|headcount.{0,20}reduc|workforce.{0,20}reduc|restructur|right.?siz)"),
)

# Event patterns in order of search (type, direction, confidence, pattern).
EVENT_PATTERNS = (
    ("factory_expansion", "positive", 0.85, r"\b(?:new|expand|opening|construct|build|break.?ground)\b.{0,80}(?:fab|factory|plant|facility|campus|site|foundry)"),
    ("factory_expansion", "positive", 0.80, r"\b(?:fab|factory|plant|facility)\b.{0,60}(?:expand|open|new|invest|billion|million)"),
    ("factory_closure", "negative", 0.85, r"\b(?:clos|shut.?down|consolidat|exit|divestiture)\b.{0,80}(?:fab|factory|plant|facility|site)"),
    ("shortage", "negative", 0.82, r"\b(?:shortage|constrain|bottleneck|allocation|lead.?time|supply.?tight|capacity.?limit)"),
    ("shortage", "negative", 0.80, r"\b(?:unable to meet|demand.{0,30}exceed.{0,30}supply|supply.{0,30}constrain)"),
    ("oversupply", "negative", 0.82, r"\b(?:oversupply|excess.{0,20}inventory|glut|channel.{0,20}inventory|elevated.{0,20}stock)"),
    ("oversupply", "negative", 0.78, r"\b(?:inventory.{0,30}correct|destocking|inventory.{0,20}normaliz)"),
    ("price_increase", "positive", 0.80, r"\b(?:price.{0,30}increas|ASP.{0,30}up|pricing.{0,20}power|rais.{0,20}price)"),
    ("price_decrease", "negative", 0.80, r"\b(?:price.{0,30}declin|ASP.{0,30}down|price.{0,30}erosion|pricing.{0,20}pressure)"),
    ("export_restriction", "negative", 0.88, r"\b(?:export.{0,30}control|export.{0,20}restrict|export.{0,20}licens|entity.{0,20}list)"),
    ("export_restriction", "negative", 0.85, r"\b(?:sanction|embargo|denied.{0,20}export|BIS.{0,20}rule)"),
    ("import_restriction", "negative", 0.82, r"\b(?:import.{0,30}tariff|import.{0,20}ban|import.{0,20}restrict|customs.{0,20}duty)"),
    ("investment_announcement", "positive", 0.88, r"\b(?:invest|commit|allocat|pledge|fund|earmark)\b.{0,60}(?:\$[\d,.]+\s*(?:billion|million|B|M|bn|mn))"),
    ("investment_announcement", "positive", 0.85, r"(?:\$[\d,.]+\s*(?:billion|million|B|M|bn|mn)).{0,60}(?:invest|capex|capital.{0,15}expenditure|program|initiative)"),
    ("partnership_announcement", "positive", 0.78, r"\b(?:partner|alliance|joint.?venture|JV|collaboration|MOU|memorandum.{0,20}understanding)\b"),
    ("partnership_announcement", "positive", 0.75, r"\b(?:strateg.{0,15}partner|long.?term.{0,15}agreement|supply.{0,15}agreement|exclusiv.{0,15}deal)\b"),
    ("acquisition", "positive", 0.85, r"\b(?:acqui(?:re|red|ring|sition)|purchase.{0,30}(?:company|business|assets?)|merger|take.?over)\b"),
    ("regulatory_approval", "positive", 0.85, r"\b(?:FDA.{0,20}approv|FCC.{0,20}approv|regulatory.{0,20}approv|CHIPS.{0,20}Act|grant.{0,20}award)\b"),
    ("regulatory_ban", "negative", 0.82, r"\b(?:FDA.{0,20}reject|banned|prohibited|enforcement.{0,20}action|fine|penalty.{0,20}regulat)\b"),
    ("technology_breakthrough", "positive", 0.75, r"\b(?:breakthrough|new.{0,20}record|industry.{0,20}first|next.?gen|advanced.{0,20}process|novel.{0,20}technolog)\b"),
    ("technology_breakthrough", "positive", 0.80, r"\b(?:2nm|3nm|angstrom|GAA|backside.{0,15}power|new.{0,20}architecture)\b"),
    ("demand_surge", "positive", 0.80, r"\b(?:backlog|record.{0,20}order|demand.{0,20}surpas|unprecedented.{0,20}demand|bookings.{0,20}strong)\b"),
    ("demand_collapse", "negative", 0.78, r"\b(?:demand.{0,30}weaken|order.{0,20}cancel|demand.{0,20}soften|shipment.{0,20}decline)\b"),
    ("supply_chain_disruption", "negative", 0.82, r"\b(?:supply.{0,20}disruption|logistic.{0,20}challenge|force.{0,10}majeure|natural.{0,20}disaster.{0,30}supply)\b"),
    ("hiring_announcement", "positive", 0.75, r"\b(?:hiring|headcount.{0,20}increas|new.{0,20}campus|expand.{0,20}workforce|creat.{0,20}\d+.{0,10}job)\b"),
)

# Technologies and sectors that a signal is about, specific ones first (name, pattern).
THEME_ENTITIES = (
    ("Data Center", r"\bdata\s+cent(?:er|re)s?\b"),
    ("Artificial Intelligence", r"\bartificial\s+intelligence\b"),
    ("Generative AI", r"\bgenerative\s+ai\b"),
    ("Machine Learning", r"\bmachine\s+learning\b"),
    ("Electric Vehicle", r"\belectric\s+vehicle|ev\s+(?:charging|manufactur|segment)\b"),
    ("Vande Bharat", r"\bvande\s+bharat\b"),
    ("Specialty Chemicals", r"\bspecialty\s+chem(?:ical)?s?\b"),
    ("Semiconductor", r"\bsemiconductor\b"),
    ("Real Estate", r"\breal\s+estate\b"),
    ("Renewable Energy", r"\brenewable\s+energy\b"),
    ("Cybersecurity", r"\bcybersecurit\w+\b"),
    ("Agrochemicals", r"\bagrochemic(?:al)?s?\b"),
    ("Herbicides", r"\bherbicid\w+\b"),
    ("Aerospace", r"\baerospace\b"),
    ("Defense", r"\bdefence|defense\b"),
    ("Automotive", r"\bautomotive\b"),
    ("Textiles", r"\btextile\b"),
    ("Pharma", r"\bpharmaceut\w+|pharma\b"),
    ("Healthcare", r"\bhealthcare|hospital\b"),
    ("Solar", r"\bsolar\b"),
    ("Wind", r"\bwind\s+(?:energy|power|turbine|farm|project)\b"),
    ("Battery", r"\bbattery\b"),
    ("Lithium", r"\blithium\b"),
    ("Cement", r"\bcement\b"),
    ("Steel", r"\bsteel\b"),
    ("Cloud", r"\bcloud\b"),
    ("Robotics", r"\brobotics?\b"),
    ("Foundry", r"\bfoundr(?:y|ies)\b"),
    ("Transformer", r"\btransformer\b"),
    ("Wafer", r"\bwafer\b"),
    ("Biotech", r"\bbiotech\b"),
    ("NBFC", r"\bnbfc\b"),
)

# Keywords of documents (entity type, confidence, words).
LEXICON = (
    ("TECHNOLOGY", 0.9, (
        "AI", "Artificial Intelligence", "Machine Learning", "Deep Learning", "Semiconductor", "Chip", "GPU", "CPU", "ASIC", "Wafer", "Foundry",
        "Electric Vehicle", "EV", "Battery", "Lithium", "Solar", "Wind", "Cloud", "Edge Computing", "5G", "6G", "Quantum Computing",
        "Biotech", "mRNA", "Gene Therapy", "CRISPR", "Drug Discovery", "Robotics", "Automation", "IoT", "Cybersecurity", "Blockchain",
        "Generative AI", "LLM", "Large Language Model", "Transformer", "Data Center", "HBM", "High Bandwidth Memory", "CoWoS",
    )),
    ("SECTOR", 0.9, (
        "Technology", "Healthcare", "Industrials", "Energy", "Financials", "Consumer Discretionary", "Consumer Staples", "Materials",
        "Utilities", "Real Estate", "Communication Services", "Semiconductor", "Pharma", "Defense", "Aerospace", "Automotive",
        "NBFC", "Infrastructure", "Specialty Chemicals", "Agrochemicals", "Textiles", "Power", "Steel", "Cement", "Logistics", "EPC",
    )),
    ("CONCEPT", 0.85, (
        "supply chain", "bottleneck", "shortage", "overcapacity", "capex", "capital expenditure", "demand surge", "headwind", "tailwind",
        "inflation", "deflation", "interest rate", "monetary policy", "geopolitical", "sanctions", "tariff", "regulatory", "ESG",
        "decarbonization", "electrification", "digitalization", "PLI scheme", "Make in India", "Atmanirbhar", "China+1",
        "import substitution", "export opportunity", "FDA", "EPA", "FTC", "CFPB", "SEBI", "RBI", "Reserve Bank of India", "NCLT",
        "CCI", "DPIIT", "NHAI", "TRAI", "IRDAI",
    )),
)

# Other names of causes.
CAUSE_ALIASES = (
    ("artificial intelligence", ("ai", "a.i.", "ai technology")),
    ("generative ai", ("gen ai", "genai", "llm", "large language model")),
    ("electric vehicle", ("ev", "evs", "electric vehicles", "bev")),
    ("data center", ("datacenter", "data centres", "data centre")),
    ("machine learning", ("ml", "deep learning")),
    ("semiconductor", ("chip", "chips", "microchip", "microchips", "ic")),
    ("power demand", ("electricity demand", "power consumption", "power", "electricity", "energy demand", "grid demand")),
    ("copper demand", ("copper", "copper supply")),
    ("transformer shortage", ("grid transformer", "electrical transformer")),
    ("mining capex", ("mining investment", "mine capex")),
    ("cloud", ("cloud computing", "hyperscaler", "hyperscalers")),
    ("cybersecurity", ("cyber security", "information security", "infosec")),
    ("lithium", ("lithium carbonate", "lithium hydroxide", "li")),
    ("battery", ("batteries", "battery storage", "battery pack")),
    ("gpu", ("graphics card", "graphics processing unit")),
    ("wafer", ("silicon wafer", "wafers")),
)

# Terms of supply chains, looked for anywhere in a theme's name and description.
SUPPLY_TERMS = (
    "memory", "hbm", "dram", "nand", "power", "electricity", "grid", "cooling", "chip", "semiconductor", "wafer", "substrate", "pcb",
    "fiber", "copper", "rare earth", "lithium", "cobalt", "nickel", "transformer", "generator", "ups", "rack", "server", "networking",
    "bandwidth", "interconnect", "packaging", "tsmc", "asml", "advanced packaging", "cowos", "chiplet", "interposer", "osat",
    "ai accelerator", "inference chip", "hbm3", "hbm3e", "substation", "transmission", "distribution", "neodymium",
    "dysprosium", "terbium", "critical mineral", "liquid cooling", "immersion cooling", "cold plate", "gigafactory", "cell manufacturing",
)

# Words too general to make themes alike, in texts and in slugs.
THEME_STOPS = ("a", "an", "the", "and", "or", "of", "in", "for", "to", "is", "are", "on", "at", "by", "from", "with", "as", "via", "vs", "demand", "supply", "constraint", "theme")
SLUG_STOPS = ("auto", "demand", "supply", "tension", "bottleneck", "surge", "capex", "buildout", "increase", "signal", "via", "downstream")
