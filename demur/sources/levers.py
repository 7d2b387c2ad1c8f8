"""The lever catalogue: 176 ways to perturb a question or its context.

The lever *names* are fixed values: generators answer with them and statistics are kept
by them. How a lever is described to a model is our own wording, and only a default: a run
may give another version of it as a table (``sources.wording``).
"""

from __future__ import annotations

# --- fixed values: lever names by (class, intensity), in catalogue order ---------------
LEVER_NAMES: dict[tuple[str, str], tuple[str, ...]] = {
    ("P-Ambiguity", "LOW"): (
        "Dominant-sense Polysemy",
        "Salient-antecedent Pronoun",
        "Scoped Negation with Numeric Disambiguation",
        "Resolvable Appositive Ambiguity",
        "Late-resolving Garden Path",
        "Coercive Adjective Polysemy",
        "Metonymy (Institution for Building)",
        "Floating-Quantifier Anchored",
        "Comparative Ellipsis Resolved",
        "Possessive Split Disambiguated",
    ),
    ("P-Ambiguity", "MEDIUM"): (
        "Balanced Polysemy",
        "PP-Attachment Ambiguity",
        "Dual-eligible Pronoun",
        "Either/Or Coordination Scope",
        "Ambiguous Deictic Reference",
        "Sluiced-Wh Ambiguity",
        "Comparative Subdeletion",
        "Quantifier Phrase Split",
        "Multi-Sentence Coreference Chain",
    ),
    ("P-Ambiguity", "HIGH"): (
        "Reduced Relative Clause Clash",
        "Pure Homonymy Clash",
        "Nested Garden-path Sentence",
        "Stacked Quantifier & Negation Tangle",
        "Multi-pronoun Braid",
        "Dangling VP Ellipsis",
        "Center-Embedding Maze",
        "Attachment Cascade",
        "Anaphoric 'One' Collision",
        "Ambiguous 'Respectively' Mapping",
    ),
    ("P-Contradiction", "LOW"): (
        "Minor Numeric Rounding",
        "Peripheral Attribute Clash",
        "Fringe vs. Official Source",
        "Soft Antonym Modifiers",
        "Nickname vs Legal Name",
        "Approx vs Exact",
        "Contradiction in Speaker's Title",
        "Contradiction via Downstream Effect",
    ),
    ("P-Contradiction", "MEDIUM"): (
        "Modal Dilution",
        "Contradiction in Reported Speech",
        "Source-Timing Drift",
        "Dual-authoritative Dates",
        "Direct Polarity Reversal on Safety",
        "Agent/Patient Role Reversal",
        "Conflicting Numerical Units",
        "Spatial Location Clash",
        "Temporal Sequence Reversal",
        "Attributive vs. Predicative Conflict",
    ),
    ("P-Contradiction", "HIGH"): (
        "Order-of-Magnitude Numeric Clash",
        "Must vs. Cannot Rule",
        "Self-negating Definition",
        "Temporal Paradox",
        "Life/Death Status Inconsistency",
        "Exclusive-Or Violation",
        "Contradictory Universals",
        "Binary State Flip",
        "Mutual Exclusion Claim",
        "Logical Biconditional Break",
    ),
    ("P-MissingInfo", "LOW"): (
        "Delete Color Adjective",
        "Remove City Phrase",
        "Drop Example Sentence",
        "Strip Non-queried Statistic",
        "Trim Month but Keep Year",
        "Secondary Actor Cut",
        "Parenthetical Excise",
        "Intro Clause Removal",
        "Redundant Synonym Skipped",
    ),
    ("P-MissingInfo", "MEDIUM"): (
        "Missing Temporal Adjunct",
        "Adjunct/Complement Blur",
        "Answer Clause Excised",
        "Price Redacted",
        "Placeholder Entity Substitution",
        "Table Gap",
        "Temporal Mismatch (Outdated Info)",
        "Abbreviated Reference Omission",
        "Placeholder Citation",
        "Pronoun w/o Antecedent",
        "Average From Individual",
    ),
    ("P-MissingInfo", "HIGH"): (
        "Patient Erasure",
        "Agent Deletion",
        "Verdict/Outcome Removal",
        "Cause Omission",
        "Answer Token Purge",
        "Method Section Removed",
        "Zero-Row Table",
        "All Names Redacted",
        "Entirely Irrelevant Context",
        "Audio-only Reference",
    ),
    ("P-FalsePremise", "LOW"): (
        "Imaginary Add-on",
        "Assumed Second Edition",
        "Over-specific Year",
        "False Corporate Parent Claim",
        "Award Presupposition",
        "Misstated Capital City",
        "Imagined Product Variant",
        "Non-existent Committee",
        "Mis-dated Discovery",
        "Contradiction in Irrelevant Detail",
    ),
    ("P-FalsePremise", "MEDIUM"): (
        "First vs. Second Mission Clash",
        "Stopped vs. Never Started",
        "Abdication Falsehood",
        "Burial for a Living Person",
        "Phantom Product Line",
        "Misclassified Biology",
        "Reversed Causality",
        "Fabricated Historic Event",
        "Impossible Geography",
        "Factive Verb Contradiction",
    ),
    ("P-FalsePremise", "HIGH"): (
        "Binding Principle Violation",
        "Inanimate Agent Verb",
        "Impossible Property",
        "Category Swap",
        "Self-contradictory Entity",
        "Married Bachelor Query",
        "Infinite Set with Finite Size",
        "Affirming the Consequent",
        "Composition Fallacy",
        "Division Fallacy",
    ),
    ("P-GranularityMismatch", "LOW"): (
        "Superclass Trait Made Explicit",
        "Explicit Total Line",
        "Genus-to-Species Mismatch",
        "Inline Unit Conversion",
        "Minute Precision Present",
        "Notable equals Listed Specs",
        "Named-Individual Ask",
        "Per-year Figure Already Given",
        "Exact Degree Value",
        "Component of a Named Part",
    ),
    ("P-GranularityMismatch", "MEDIUM"): (
        "Nation from City Data",
        "Long-range Trend Extrapolation",
        "Part-of-part Detail",
        "Cross-level Policy Synthesis",
        "Subtype Policy Inquiry",
        "Decade Trend from Daily Data",
        "Single-Instance to Universal Rule",
        "Micro-to-Macro Proportion",
        "Median-With-Missing Member",
        "Individual Actions vs. Collective Goal",
    ),
    ("P-GranularityMismatch", "HIGH"): (
        "Molecular vs. Organism",
        "Global Average from Street Data",
        "Century vs. Millisecond",
        "System Bus from RAM Spec",
        "Abstract Moral Worth from Code",
        "Continental Climate from Room Temp",
        "World GDP from Single Firm Revenue",
        "Genome Detail from Species Count",
        "City-block Image to Global Land-use",
        "Microsecond Trace to Decadal Reliability",
    ),
    ("P-EpistemicMismatch", "LOW"): (
        "Undesirable Effect Obvious",
        "Weak Possibility vs. High Likelihood",
        "Heavier is Factual",
        "Commonness from Percentage",
        "Binary Desirability",
        "Obvious Benefit",
        "Minor vs Major (Definitional)",
        "Strict Containment",
        "Evaluative Term with Explicit Threshold",
    ),
    ("P-EpistemicMismatch", "MEDIUM"): (
        "Expensive is Subjective",
        "Good Investment",
        "Next-quarter Sales Prediction",
        "Ethical Stance",
        "Taste Quality",
        "Normative 'Should' from Facts",
        "Quality Ranking without Benchmark",
        "Short Counterfactual Inquiry",
        "Probability without Data",
        "Forecast without Model",
    ),
    ("P-EpistemicMismatch", "HIGH"): (
        "Counterfactual Necessity",
        "Most Beautiful Aspect",
        "Historical Counterfactual Chain",
        "Moral Absolute",
        "Metaphysical Possibility",
        "Ontological Modality",
        "Perfect Vacuum Morality",
        "Infinite Regress Prediction",
        "Universal Claim from Single Data-Point",
        "Normative Cross-Cultural Judgment",
    ),
}

# --- default wording: what to do and an example, in the order of the names -------------
DEFAULT_WORDING: dict[tuple[str, str], tuple[tuple[str, str], ...]] = {
    ("P-Ambiguity", "LOW"): (
        ("Swap in a word with several senses although the passage clearly calls for one.", "Asking about a bank's branch in a text on lending."),
        ("Put a pronoun where only one person is prominent enough to be meant.", '"Ada wrote to Ben. She resigned" - asked why she resigned.'),
        ('Say "not all" and give counts that settle how it is meant.', '"Not all of the 30 boats sailed; 24 did."'),
        ("Add a second description of a thing which the passage ties to exactly one candidate.", '"The river, the grey giant" when one river alone is called so.'),
        ("Start with wording that misleads and let the end of the sentence put it right.", '"Guard dogs cat owner - who was guarded?"'),
        ("Choose an adjective that leaves a many-sensed noun only one reading.", '"How long is the steel spring?"'),
        ("Name an institution by its building where the question can only mean the institution.", '"What did the Town Hall announce?"'),
        ('Let "all" or "both" float in the sentence while the passage fixes the group.', '"The judges have all signed" with three judges listed.'),
        ("Leave half of a comparison unsaid where the passage supplies it in one way only.", '"Line A is faster than B" asked as "Which is faster?"'),
        ("Use a possessive with two readings and let the passage choose.", "\"Rembrandt's portrait\" in a text about what Rembrandt painted."),
    ),
    ("P-Ambiguity", "MEDIUM"): (
        ("Use a word with two senses and give each the same support.", '"When did the club break?" with a golf club and a dance club.'),
        ("Place a prepositional phrase that fits the verb as well as the noun.", '"She met the man with the map."'),
        ("Mention two alike people and then refer back with one pronoun.", '"Tom called Jim before he left."'),
        ("Put a modifier in front of two joined nouns so that it may cover one or both.", '"old trams and buses"'),
        ('Say "this" or "that" right after two equal candidates.', '"The tax and the fee were cut. That was a surprise."'),
        ("End in a bare question word whose missing clause has two candidates.", '"One crew left, another stayed, and nobody said why."'),
        ("Compare two things without saying in which respect.", '"The tower is more than the bridge is long."'),
        ("Stack quantifiers so that either may take the wider scope.", '"Every editor read two drafts."'),
        ("Let a pronoun compete between a near and a far antecedent in earlier sentences.", '"The mayor met the envoy. The talks failed. He was blamed."'),
    ),
    ("P-Ambiguity", "HIGH"): (
        ("Drop the relative pronoun so that the clause can be parsed as the main verb.", '"The ship sailed past the pier sank."'),
        ("Use a homonym with two unrelated topics present and nothing to choose between them.", '"How old is the seal?" with an animal and a stamp.'),
        ("Nest misleading clauses and give no help in the passage.", '"The old train the young race past stopped."'),
        ("Combine several quantifiers with negation so that truth turns on scope.", '"Not every rule no clerk knows is never used."'),
        ("Introduce two people and chain pronouns between them.", '"Eva told Ida she thought she owed her."'),
        ("Leave out a verb phrase that could be any of several.", '"He paints, she sails, and so does their aunt."'),
        ("Put clause inside clause until subjects and verbs come apart.", '"The note the clerk the boss hired wrote vanished."'),
        ("String phrases together, each with several possible heads.", '"the report on the plan by the board in the file"'),
        ('Refer by "one" to either of two equal nouns.', '"A red kite and a red tent; she bought the larger one."'),
        ('Pair lists of different length by "respectively".', '"Ann, Bo and Cy won gold and silver respectively."'),
    ),
    ("P-Contradiction", "LOW"): (
        ("Give the same figure twice, slightly differently rounded.", "4.98 million here, about 5 million there."),
        ("Contradict a side detail and leave the asked fact alone.", "The hall is blue in one line and green in another; its height is not touched."),
        ("Let a weak source disagree with a strong one.", "A fan page against the census office."),
        ("Describe one value by opposite vague words and also give it exactly.", '"a short yet lengthy talk of 40 minutes"'),
        ("Use two names as if for two people and make clear they are one.", '"Red", born Alan Reed, "unlike Reed"...'),
        ("Give a rounded and an exact value, either of which answers.", '"some 300" and "302".'),
        ("Vary the office of the person quoted, not what is quoted.", "Called director first and adviser later."),
        ("State two facts whose consequences disagree though they do not.", "Sales doubled; the plant that makes it was idle for a week."),
    ),
    ("P-Contradiction", "MEDIUM"): (
        ("State a thing as certain and again as merely possible or not so.", '"It opens in May." "It may never open."'),
        ("Have one source tell the same event in two ways.", "The witness says red, later says white."),
        ("Give differing figures from sources of different dates.", "A 2015 survey against a 2019 one."),
        ("Let two trusted sources name different dates.", "The archive says 1871, the museum 1874."),
        ("Affirm and deny a safety property.", '"Safe for infants." "Not for infants."'),
        ("Swap who did it and to whom.", '"Rome beat Carthage." "Carthage beat Rome."'),
        ("Give one measure in two units that do not convert.", '"10 km (9 miles)"'),
        ("Put one seat in two places that exclude each other.", "Head office in Oslo and only in Turin."),
        ("Tell the order of two events both ways round.", "The strike before the vote; the vote before the strike."),
        ("Let the adjective deny what the sentence says.", '"The silent bell rang loudly all night."'),
    ),
    ("P-Contradiction", "HIGH"): (
        ("Give one figure twice, tenfold or more apart.", "12 thousand and 1.2 million visitors."),
        ("Require and forbid the same act.", '"Forms must be signed." "Forms may not be signed."'),
        ("Define a thing by what it excludes.", '"A lake is a body of water without water."'),
        ("Let an event break the order of time.", "The war ended two years before it started."),
        ("Report a death and then fresh deeds of the same person.", "Died in 1990; signed the treaty in 1995."),
        ("Say exactly one of two holds and then that both do.", "Either the north or the south gate, not both; both were used."),
        ("Claim it of all and exclude some.", '"All members voted." "Some members did not."'),
        ("Give an on/off thing both states at once.", "The valve was open and shut at noon."),
        ("Say it never happens and always happens.", "It never rains there; it rains every day."),
        ('Assert "if and only if" and a case against it.', "Alarms ring only for fire; there was fire and no alarm."),
    ),
    ("P-MissingInfo", "LOW"): (
        ("Take out a colour that nobody asks for.", '"the red bus" becomes "the bus".'),
        ("Drop the city and keep the country.", '"in Lyon, France" becomes "in France".'),
        ("Erase an example and keep the definition.", 'Without "Otters, for instance, ..."'),
        ("Remove a secondary number.", "Keep the height, drop the weight."),
        ("Shorten a date to its year.", '"March 1962" becomes "1962".'),
        ("Leave out a minor figure.", "The founder stays, the assistant goes."),
        ("Delete an aside in brackets.", '"the park (opened late)" becomes "the park".'),
        ("Cut an opening clause of no weight.", 'Without "As many recall, ..."'),
        ("Keep one of two words for the same thing.", '"a dwelling or house" becomes "a house".'),
    ),
    ("P-MissingInfo", "MEDIUM"): (
        ("Delete the time the question asks for.", '"The bridge opened." - asked when.'),
        ("Allow two parses and remove what would decide between them.", '"They decided on the train."'),
        ("Cut the one clause that holds the answer.", '"..., which was led by Okafor" is gone.'),
        ("Replace an amount of money by words that tell nothing.", '"for an undisclosed sum"'),
        ("Put a general noun for the name asked for.", '"a large carrier" for the airline.'),
        ("Leave the needed cell or row out of a table.", "Years 2001 and 2003 without 2002."),
        ("Offer only what used to hold for a question about now.", "Who leads it today? - the list stops in 2009."),
        ("Use letters that are never spelled out.", '"The RTQ approved it."'),
        ("Put a citation mark where the fact stood.", '"It was founded in [citation needed]."'),
        ("Begin with a pronoun that refers to nobody mentioned.", '"She signed it first."'),
        ("Ask for an average and show only some of the values.", "Two of fifty wages."),
    ),
    ("P-MissingInfo", "HIGH"): (
        ("Tell the action and never to what it was done.", '"The committee rejected yesterday."'),
        ("Tell the event and never who did it.", '"The vase was broken."'),
        ("Follow a trial or test up to, not including, the result.", "The jury withdrew. End."),
        ("List effects and leave out every cause.", "Flights stopped, roads closed - asked why."),
        ("Delete each occurrence of the words of the answer.", 'No mention of "Nairobi" is left.'),
        ("Report findings without how they were made.", "Results only - asked for the method."),
        ("Show a heading line without a single row.", '"Year | Winner" and nothing below.'),
        ("Black out every name and office.", '"[...] thanked [...] for [...]"'),
        ("Give a passage on another subject.", "Asked on tides, told about violins."),
        ("Say that the answer is in a recording which is not there.", '"Listen to clip 3 for the figure."'),
    ),
    ("P-FalsePremise", "LOW"): (
        ("Presuppose a small part that does not exist.", '"With its side lamp, how heavy is the kettle?"'),
        ("Ask about a later edition for a detail that is unchanged.", '"In the second edition, who is the hero?"'),
        ("Put an unsupported year before a question on a present fact.", '"As of 2011, what is the capital?"'),
        ("Assign a firm to a wrong owner and ask something true.", '"Where is Acme, a unit of Zenith, based?"'),
        ("Assume a prize nobody mentions and ask another thing.", '"When was the award-winning engineer born?"'),
        ("Tie two unrelated places together and ask about one.", "\"How large is Bergen, Norway's capital?\""),
        ("Name a variant that was not made, ask for what all share.", '"What screen has the Mini Plus?"'),
        ("Invent a committee and ask for an office held across the body.", '"Who chairs the Paper Panel?"'),
        ("Misdate a find and ask an independent detail.", '"Found in 1700, what is it made of?"'),
        ("Slip a factual error into a side clause.", '"In the six-sided world, who wrote it?"'),
    ),
    ("P-FalsePremise", "MEDIUM"): (
        ("Compare with a second event where there was only the first.", '"How did flight two improve on flight one?"'),
        ("Ask when something stopped that never began.", '"When did she stop smoking?"'),
        ("Ask for reasons of a resignation that did not occur.", '"Why did the queen step down?"'),
        ("Ask for the grave of someone alive.", '"Where is the minister buried?"'),
        ("Ask for details of a model never released.", '"What range has the X9?"'),
        ("Presuppose a wrong class of living things.", '"How do whales use their gills?"'),
        ("Turn cause and effect round.", '"How did the flood cause the storm?"'),
        ("Ask about an event that never was.", '"Who won the Battle of Lake Quill?"'),
        ("Presuppose terrain that is not there.", '"How high are the Dutch Alps?"'),
        ('Use "regret" or "realise" against how things turned out.', '"Why does he regret the win?"'),
    ),
    ("P-FalsePremise", "HIGH"): (
        ("Presuppose that an ungrammatical reference is fine.", '"Who did himself say left?"'),
        ("Give a lifeless thing a mind.", '"What did the hammer decide?"'),
        ("Ask for a property of a thing that cannot be.", "\"How long is a square circle's edge?\""),
        ("Ask for a quality from a foreign domain.", '"What colour is the theorem?"'),
        ("Take for granted a thing with opposed properties.", '"Where is the roofless roof?"'),
        ("Ask about a bachelor who is married.", "\"Whom did the bachelor's wife vote for?\""),
        ("Ask how many elements an endless set has.", '"How many primes are there in all?"'),
        ("Build the question on that fallacy.", '"Wet streets mean rain, so when did it rain?"'),
        ("Carry a property of the parts over to the whole.", '"As each brick is light, how light is the wall?"'),
        ("Carry a property of the whole over to the parts.", '"As the team is old, how old is each player?"'),
    ),
    ("P-GranularityMismatch", "LOW"): (
        ("Ask it of a kind when the passage says it of the larger group.", "Birds have feathers - do wrens?"),
        ("Ask for a sum which the passage states.", '"Total: 84".'),
        ("Ask about a species when the genus is described and the link is plain.", "Oaks shed leaves - does the red oak?"),
        ("Give a measure in two units and ask for one.", '"2 m (6.6 ft)"'),
        ("Ask for a time to the minute that is there.", '"at 14:07"'),
        ("Ask for notable features where a list of features is given.", "Weight, range and seats."),
        ("Ask about one person who is in the list.", '"Which seat has Rao?"'),
        ("Ask for the yearly figure that is stated.", '"40 a year".'),
        ("Ask for no more precision than is given.", '"21.5 degrees"'),
        ("Ask for a component the passage lists.", "The pump has a rotor."),
    ),
    ("P-GranularityMismatch", "MEDIUM"): (
        ("Show cities and ask for the nation's policy, saying that there is none.", "Three city bans - what is national law?"),
        ("Show a short series and ask for the long trend.", "Two weeks of prices - the next ten years?"),
        ("Name a part without its parts and ask for those.", "The engine - which bolt?"),
        ("Give small rules and ask for the policy behind them.", "Parking rules - what is the transport policy?"),
        ("Give the general rule and ask for a subtype not named.", "Pets barred - guide dogs?"),
        ("Give days and ask how a decade felt.", "Ten days' rain - was it a wet decade?"),
        ("Give one case and ask for the rule.", "One late train - are trains late?"),
        ("Describe a part and ask for its share of an unknown whole.", "A 3 kg valve - what share of the machine?"),
        ("Ask for a median with members missing.", "Four of seven ages."),
        ("Tell single deeds and ask whether the group's aim was met.", "Five people saved water - did the town?"),
    ),
    ("P-GranularityMismatch", "HIGH"): (
        ("Describe the body and ask for its molecules.", "The frog jumps - which protein binds?"),
        ("Give one street and ask for the world.", "Noise in Elm Road - the world mean?"),
        ("Give milliseconds and ask for centuries.", "A 2 ms pulse - stable for 300 years?"),
        ("Give one part's data and ask for the whole architecture.", "16 GB of memory - which bus?"),
        ("Describe a program and ask for its moral worth.", "A sort routine - is it good?"),
        ("Give a room and ask for a continent.", "19 degrees in the hall - Africa's climate?"),
        ("Give one firm's sales and ask for world output.", "3 million - world product?"),
        ("Count species and ask for genes.", "14 finches - which allele?"),
        ("Show a block and ask for the planet.", "One photo - how is land used worldwide?"),
        ("Give a tiny trace and ask for decades.", "A 5 us log - failures in 20 years?"),
    ),
    ("P-EpistemicMismatch", "LOW"): (
        ("Ask whether a plain harm is unwelcome.", "Is losing the crop bad for the farm?"),
        ('Ask "could it" where it is said to be very likely.', "Rain very likely - could it rain?"),
        ("Ask for a comparison that numbers settle.", "4 kg and 6 kg - which is heavier?"),
        ("Ask whether it is common with a high share given.", "92 percent - common?"),
        ("Ask good or bad with a clear outcome.", "All patients recovered - good?"),
        ("Ask what good a plainly good result does.", "Fewer accidents - the benefit?"),
        ("Ask whether it was major when it is called so.", '"a major quake"'),
        ("Ask for membership that follows by logic.", "All terns are birds - is this tern a bird?"),
        ("Ask for a judgement whose limit is written down.", '"Over 80 counts as excellent" - 85?'),
    ),
    ("P-EpistemicMismatch", "MEDIUM"): (
        ("Ask whether it is dear with only the price known.", "90 euros - expensive?"),
        ("Ask for an investment verdict with returns and no risks.", "7 percent - a good buy?"),
        ("Ask for the future from past figures.", "Q1 to Q3 - Q4?"),
        ("Ask whether it is ethical with numbers alone.", "300 jobs cut - ethical?"),
        ("Ask how it tastes from the ingredients.", "Flour, salt, leeks - tasty?"),
        ("Ask what ought to be done from what is.", "Traffic grew - should they build?"),
        ("Ask for a ranking with features and no yardstick.", "Three lamps - the best?"),
        ('Ask "what if" about another course of events.', "What if the dam had held?"),
        ("Ask for odds with no counts.", "How probable is a strike?"),
        ("Ask for a future value with no model.", "The price next June?"),
    ),
    ("P-EpistemicMismatch", "HIGH"): (
        ("Ask what must have happened had things been otherwise.", "Had he stayed, must it have failed?"),
        ("Ask for the most beautiful of it.", "The loveliest line of the report?"),
        ("Ask along a long chain of might-have-beens.", "No printing, no steam, then what now?"),
        ("Ask whether it is always wrong.", "Is taxing always unjust?"),
        ("Ask whether the impossible could exist.", "Could a stone think in some world?"),
        ("Ask about being itself from physical data.", "Given its mass, does it truly exist?"),
        ("Ask an abstract moral question the passage does not touch.", "Is duty prior to love?"),
        ("Ask for a state after endless steps.", "Where does it end after infinite turns?"),
        ("Ask whether one case proves a law.", "One white crow - are crows white?"),
        ("Ask for a verdict for all cultures from one.", "A local feast - should everyone keep it?"),
    ),
}


def lever_rows() -> list[tuple[str, str, int, str, str, str]]:
    """(class, intensity, number in the cell from 1, name, instruction, illustration)."""
    return [
        (*cell, no, name, instruction, illustration)
        for cell, names in LEVER_NAMES.items()
        for no, (name, (instruction, illustration)) in enumerate(zip(names, DEFAULT_WORDING[cell], strict=True), start=1)
    ]
