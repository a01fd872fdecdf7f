"""Default name lists of the gazetteer: common Indian given names and surnames, from general knowledge.

They are short. Both are parameters of the detector; :func:`from_table` reads larger ones, and
:mod:`name_join` joins texts with a dictionary of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names travel with the detector to every task, so a table of them must stay below this.
MOST_NAMES = 1_000_000


def from_table(table: DataFrame) -> dict[str, frozenset[str]]:
    """``given`` and ``surnames`` for the detector from rows (name, kind: given or surname)."""
    rows = table.where("name IS NOT NULL").select(F.lower("name").alias("name"), "kind").distinct().limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    return {kind + "s" * (kind == "surname"): frozenset(r["name"] for r in rows if r["kind"] == kind) for kind in ("given", "surname")}



GIVEN = frozenset(
    "aarav aditi aditya ajay akash amit amita amol ananya anil anita anjali ankit anupama arjun arun aruna asha ashok ashwin bhavna chandra deepa deepak devika dinesh divya farhan "
    "fatima gaurav gauri geeta girish gita gopal govind hari harish hema imran ishaan jaya jyoti kabir kamala karan kavita kavya kiran kishore krishna lakshmi lata lalita madhav madhuri "
    "mahesh manish manoj meena meera mohan mohit mukesh nandini naveen neha nikhil nisha nitin padma pankaj parvati pooja pradeep prakash pranav prasad priya rahul raj raja rajesh rajiv "
    "rakesh ram ramesh rani ravi rekha renu riya rohan rohit sachin sandeep sanjay sanjana santosh sarita satish seema shalini shanti shreya shyam sita sneha sonia sourav srinivas sudha "
    "suman sunil sunita suresh sushma tara uma usha vandana varun vidya vijay vikas vikram vinay vinod vivek yash zoya".split()
)
SURNAMES = frozenset(
    "agarwal ahmed ansari apte banerjee bansal bhat bhatt bhatia bose chakraborty chatterjee chauhan chavan chopra choudhary das datta desai deshmukh deshpande dey dhawan dixit dubey "
    "dutta gandhi garg ghosh gill goel gowda goyal gupta hegde hussain iyengar iyer jadhav jain jha joshi kale kapoor kaur khan khanna kulkarni kumar mahajan malhotra malik mehra mehta "
    "menon mishra mukherjee murthy nair naidu nayak pandey pandit parekh patel patil pawar pillai prasad rao rathore rawat reddy roy saha saxena sen sethi shah sharma shetty shinde shukla "
    "singh sinha soni srivastava subramanian thakur tiwari trivedi tyagi varma verma yadav".split()
)
#: Capitalised words that make a place, shop or page name of the given name before them (fixed values).
NOT_SURNAME = frozenset(
    "road street marg nagar colony lane sector chowk services home details status traders enterprises hospital school college bank express travels motors stores store agency industries "
    "limited ltd pvt private group foundation trust society clinic medical pharmacy academy institute university temple masjid church market mall tower park garden hotel restaurant cafe "
    "kitchen foods dairy textiles jewellers electronics solutions technologies systems consultancy associates brothers sons co company account settings profile dashboard inbox sent drafts "
    "archive starred compose reply help support login logout register search menu next back submit cancel save edit delete update download upload share print view more less vihar bhawan "
    "hall centre center office station airport junction layout apartments residency heights enclave camp cross circle bazar bazaar".split()
)
