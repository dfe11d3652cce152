"""Parsing-expression grammars, written from the languages' public specifications. See peg.py for the notation.

Only the language of valid files matters here, not the tree: chains of binary operators are flat.
"""

JAVA = r"""
file <- (annotation* 'package' qname ';')? (import / ';')* (module / (type_decl / ';')*) EOF
module <- annotation* "open"? "module" qname '{' (!'}' (ID / ',' / ';' / '.' / 'static'))* '}' 
import <- 'import' 'static'? qname ('.' '*')? ';'
qname <- ID ('.' ID)*
annotation <- '@' qname ('(' (element (',' element)*)? ')')?
element <- ID '=' value / value
value <- annotation / '{' (value (',' value)*)? ','? '}' / cond
modifier <- annotation / 'public' / 'protected' / 'private' / 'static' / 'abstract' / 'final' / 'native' / 'synchronized' / 'transient' / 'volatile' / 'strictfp' / 'default' !(':' / '->')
    / "sealed" &('class' / 'interface' / 'abstract' / 'public' / 'static' / 'private' / 'protected' / 'strictfp') / "non" '-' "sealed"
type_decl <- modifier* type_rest
type_rest <- class / interface / enum / annotation_type / record
class <- 'class' ID tparams? ('extends' type)? ('implements' types)? ("permits" types)? body
interface <- 'interface' ID tparams? ('extends' types)? ("permits" types)? body
enum <- 'enum' ID ('implements' types)? '{' (constant (',' constant)*)? ','? (';' member*)? '}'
constant <- annotation* ID args? body?
record <- "record" ID tparams? '(' (component (',' component)*)? ')' ('implements' types)? body
component <- annotation* type '...'? ID
annotation_type <- '@' 'interface' ID body
types <- type (',' type)*
tparams <- '<' tparam (',' tparam)* close
tparam <- annotation* ID ('extends' type ('&' type)*)?
close <- '>' / G
body <- '{' member* '}'
member <- ';' / 'static'? block / modifier* (type_rest / tparams? ID params throws? block / ID block / tparams? (type / 'void') ID method / type declarator (',' declarator)* ';')
method <- params dims throws? (block / ('default' value)? ';')
params <- '(' (param (',' param)*)? ')'
param <- (annotation / 'final')* type annotation* ('...' ID / (ID '.')* 'this' / ID dims)
throws <- 'throws' types
dims <- (annotation* '[' ']')*
declarator <- ID dims ('=' init)?
init <- array_init / expr
array_init <- '{' (init (',' init)*)? ','? '}'
type <- annotation* (prim / class_type) dims
prim <- 'boolean' / 'byte' / 'short' / 'int' / 'long' / 'char' / 'float' / 'double'
class_type <- ID targs? ('.' annotation* ID targs?)*
targs <- '<' (targ (',' targ)*)? close
targ <- annotation* '?' (('extends' / 'super') type)? / type
block <- '{' block_stmt* '}'
block_stmt <- modifier* (class / record / enum / interface) / local ';' / stmt
local <- (annotation / 'final')* type declarator (',' declarator)*
stmt <- block / ';' / 'if' paren stmt ('else' stmt)? / for / 'while' paren stmt / 'do' stmt 'while' paren ';' / 'switch' paren switch_body / try
    / 'return' expr? ';' / 'throw' expr ';' / 'break' ID? ';' / 'continue' ID? ';' / 'synchronized' paren block / 'assert' expr (':' expr)? ';'
    / ID ':' stmt / "yield" expr ';' / action ';'
paren <- '(' expr ')'
for <- 'for' '(' ((annotation / 'final')* type ID dims ':' expr / (local / action (',' action)*)? ';' expr? ';' (action (',' action)*)?) ')' stmt
try <- 'try' ('(' resource (';' resource)* ';'? ')' block catch* finally? / block (catch+ finally? / finally))
resource <- (annotation / 'final')* type ID '=' expr / postfix
catch <- 'catch' '(' (annotation / 'final')* type ('|' type)* ID ')' block
finally <- 'finally' block
switch_body <- '{' (label_list '->' (block / 'throw' expr ';' / expr ';'))+ '}' / '{' ((label_list ':')+ block_stmt*)* '}'
label_list <- 'default' / 'case' cond (',' cond)*
action <- ('++' / '--') unary / atom suffix* assign_op expr / atom suffix* ('++' / '--') / calls
calls <- (creation / atom_call / (&atom_call atom)) (plain* call)* / atom (plain* call)+
atom_call <- targs_call / ID args / ('this' / 'super') args
targs_call <- ID '.' targs ID args
plain <- !call suffix
call <- '.' targs? ID args / '.' 'new' creation_rest / '.' 'super' args / '.' targs 'super' args
assign_op <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>=' / G G? '>='
expr <- lambda / cond (('=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / G G? '>=') expr)?
lambda <- (ID / '(' (lparam (',' lparam)*)? ')') '->' (block / expr)
lparam <- param / ID
cond <- binary ('?' expr ':' (lambda / cond))?
binary <- unary (operator unary / 'instanceof' 'final'? type ID?)*
operator <- '||' / '&&' / '|' / '^' / '&' / '==' / '!=' / '<=' / '>=' / '<<' / '<' / G G '>' / G '>' / '>' / '+' / '-' / '*' / '/' / '%'
unary <- ('++' / '--' / '+' / '-') unary / other
other <- ('!' / '~') unary / cast / postfix
cast <- '(' prim dims ')' unary / '(' type ('&' type)* ')' (lambda / other)
postfix <- atom suffix* ('++' / '--')*
atom <- 'switch' paren switch_body / paren / literal / 'this' args? / 'super' (args / &'.' / &'::') / creation / prim dims ('.' 'class' / '::' 'new') / 'void' '.' 'class'
    / ID targs ('.' ID targs?)* dims '::' targs? (ID / 'new') / ID ('.' ID)* '[' ']' dims ('::' 'new' / '.' 'class') / ID args?
literal <- NUM / STR / CHAR / 'true' / 'false' / 'null'
suffix <- '.' (ID args? / 'this' / 'class' / 'new' creation_rest / targs (ID / 'super') args / 'super' (args / '.' ID args? / &'::')) / '[' expr ']' / '::' targs? (ID / 'new')
creation <- 'new' creation_rest
creation_rest <- annotation* targs? (prim / class_type) (args body? / (annotation* '[' expr ']')+ dims / ('[' ']')+ array_init)
args <- '(' (expr (',' expr)*)? ')'
"""

GO = r"""
file <- 'package' ID ';' ('import' (spec_import / '(' (spec_import ';')* spec_import? ')') ';')* (top ';')* EOF
spec_import <- ('.' / ID)? STR
top <- function / declaration
declaration <- 'const' (const / '(' (const ';')* const? ')') / 'var' (var / '(' (var ';')* var? ')') / 'type' (typedef / '(' (typedef ';')* typedef? ')')
const <- names (type? '=' exprs)?
var <- names (type ('=' exprs)? / '=' exprs)
typedef <- ID '=' type / ID '[' tparam (',' tparam)* ','? ']' '='? type / ID type
tparam <- names constraint
constraint <- '~'? type ('|' '~'? type)*
names <- ID (',' ID)*
function <- 'func' params ID signature block? / 'func' ID ('[' tparam (',' tparam)* ','? ']')? signature block?
signature <- params result?
result <- params / type
params <- '(' (param (',' param)*)? ','? ')'
param <- ID '...'? type / '...' type / type
type <- '(' type ')' / name / '[' '...' ']' type / '[' expr ']' type / '[' ']' type / 'struct' '{' (field ';')* field? '}' / '*' type / 'func' signature
    / 'interface' '{' (member ';')* member? '}' / 'map' '[' type ']' type / 'chan' '<-'? type / '<-' 'chan' type
name <- ID ('.' ID)? ('[' type (',' type)* ','? ']')?
field <- (names type / '*'? name) STR?
member <- ID signature / constraint
block <- '{' (stmt? ';')* stmt? '}'
stmt <- declaration / ID ':' (!('}' / ';') stmt)? / block / 'go' expr / 'defer' expr / 'return' exprs? / 'break' ID? / 'continue' ID? / 'goto' ID / 'fallthrough' / if / switch / select / for / simple
simple <- exprs (assign exprs / ':=' exprs / '++' / '--' / '<-' expr)?
assign <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '&^='
if <- 'if' (head_simple? ';')? head block ('else' (if / block))?
head_simple <- heads (assign heads / ':=' heads / '++' / '--' / '<-' head)?
switch <- 'switch' ((head_simple? ';')? (head_guard / head)?) '{' (case ':' (stmt? ';')* stmt?)* '}'
head_guard <- (ID ':=')? head_unary_type
head_unary_type <- head_operand (!('.' '(' 'type' ')') head_suffix)* '.' '(' 'type' ')'
case <- 'case' (type_or_expr (',' type_or_expr)*) / 'default'
type_or_expr <- expr / type
select <- 'select' '{' (('case' (exprs ('=' / ':=') expr / expr '<-' expr / expr) / 'default') ':' (stmt? ';')* stmt?)* '}'
for <- 'for' ((heads (':=' / '='))? 'range' head / head_simple? ';' head? ';' head_simple? / head)? block
exprs <- expr (',' expr)*
expr <- unary (operator unary)*
operator <- '||' / '&&' / '==' / '!=' / '<=' / '>=' / '<<' / '>>' / '<' / '>' / '+' / '-' / '|' / '^' / '*' / '/' / '%' / '&^' / '&'
unary <- ('+' / '-' / '!' / '^' / '*' / '&' / '<-') unary / operand suffix*
operand <- NUM / STR / CHAR / 'func' signature block / literal_type literal / name literal / ID / '(' type_or_expr ')' / conversion
conversion <- type &('(')
literal_type <- 'struct' '{' (field ';')* field? '}' / '[' '...' ']' type / '[' expr ']' type / '[' ']' type / 'map' '[' type ']' type
literal <- '{' (element (',' element)*)? ','? '}'
element <- (literal / expr) (':' (literal / expr))?
suffix <- '.' ID / '.' '(' type ')' / '[' expr? ':' expr? (':' expr)? ']' / '[' type_or_expr (',' type_or_expr)* ','? ']' / '(' (type_or_expr (',' type_or_expr)* '...'? ','?)? ')'
heads <- head (',' head)*
head <- head_unary (operator head_unary)*
head_unary <- ('+' / '-' / '!' / '^' / '*' / '&' / '<-') head_unary / head_operand head_suffix*
head_operand <- NUM / STR / CHAR / 'func' signature block / literal_type literal / ID / '(' type_or_expr ')' / conversion
head_suffix <- suffix
"""

PYTHON = r"""
file <- (stmt / NEWLINE)* EOF
stmt <- compound / simples
simples <- simple (';' simple)* ';'? NEWLINE
simple <- "type" ID tparams? '=' expr / assignment / star_exprs / 'return' star_exprs? / import / 'raise' (expr ('from' expr)?)? / 'pass' / 'del' del_target (',' del_target)* ','? / yield / 'assert' expr (',' expr)? / 'break' / 'continue' / 'global' ID (',' ID)* / 'nonlocal' ID (',' ID)*
assignment <- single ':' expr ('=' (yield / star_exprs))? / (targets '=')+ (yield / star_exprs) !'=' / single augmented (yield / star_exprs)
augmented <- '+=' / '-=' / '*=' / '@=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '**=' / '//='
single <- member_target / ID / '(' single ')'
member_target <- atom (suffix &('.' / '[' / '('))* ('.' ID / '[' slices ']') !('.' / '[' / '(')
targets <- star_target (',' star_target)* ','? &('=' / 'in')
star_target <- '*' !'*' target / target
target <- member_target / ID / '(' (star_target (',' star_target)* ','?)? ')' / '[' (star_target (',' star_target)* ','?)? ']'
del_target <- member_target / ID / '(' (del_target (',' del_target)* ','?)? ')' / '[' (del_target (',' del_target)* ','?)? ']'
import <- 'import' dotted ('as' ID)? (',' dotted ('as' ID)?)* / 'from' (('.' / '...')* dotted / ('.' / '...')+) 'import' ('*' / '(' from (',' from)* ','? ')' / from (',' from)*)
dotted <- ID ('.' ID)*
from <- ID ('as' ID)?
compound <- decorated / function / class / 'if' named ':' block ('elif' named ':' block)* else? / 'while' named ':' block else? / for / with / try / match / 'async' (function / for / with)
else <- 'else' ':' block
decorated <- ('@' named NEWLINE)+ (class / 'async'? function)
block <- NEWLINE INDENT stmt+ DEDENT / simples
class <- 'class' ID tparams? ('(' args? ')')? ':' block
function <- 'def' ID tparams? '(' params? ')' ('->' expr)? ':' block
tparams <- '[' tparam (',' tparam)* ','? ']'
tparam <- ('*' / '**')? ID (':' expr)? ('=' star_expr)?
params <- param (',' param)* ','?
param <- '/' / '**' ID annotation? / '*' (ID star_annotation?)? / ID annotation? ('=' expr)?
annotation <- ':' expr
star_annotation <- ':' star_expr
for <- 'for' for_targets 'in' star_exprs ':' block else?
for_targets <- star_target (',' star_target)* ','?
with <- 'with' ('(' with_item (',' with_item)* ','? ')' ':' / with_item (',' with_item)* ':') block
with_item <- expr ('as' star_target)?
try <- 'try' ':' block ('finally' ':' block / ('except' '*' expr ('as' ID)? ':' block)+ else? ('finally' ':' block)? / except+ else? ('finally' ':' block)?)
except <- 'except' (expr ('as' ID)?)? ':' block
match <- "match" star_exprs ':' NEWLINE INDENT case+ DEDENT
case <- "case" patterns ('if' named)? ':' block
patterns <- star_pattern (',' star_pattern)* ','?
star_pattern <- '*' ID / pattern
pattern <- or_pattern ('as' ID)?
or_pattern <- closed ('|' closed)*
closed <- '-'? NUM (('+' / '-') NUM)? / (STR / fstring)+ / 'None' / 'True' / 'False' / dotted '(' (pattern_arg (',' pattern_arg)* ','?)? ')' / dotted / '(' (star_pattern (',' star_pattern)* ','?)? ')' / '[' (star_pattern (',' star_pattern)* ','?)? ']'
    / '{' (item_pattern (',' item_pattern)* ','?)? '}'
pattern_arg <- ID '=' pattern / pattern
item_pattern <- '**' ID / ('-'? NUM (('+' / '-') NUM)? / STR+ / 'None' / 'True' / 'False' / dotted) ':' pattern
yield <- 'yield' ('from' expr / star_exprs)?
star_exprs <- star_expr (',' star_expr)* ','?
star_expr <- '*' bit / expr
star_named <- '*' bit / named
named <- ID ':=' expr / expr !':='
expr <- 'lambda' lparams? ':' expr / disjunction ('if' disjunction 'else' expr)?
lparams <- lparam (',' lparam)* ','?
lparam <- '/' / '**' ID / '*' ID? / ID ('=' expr)?
disjunction <- inversion (('or' / 'and') inversion)*
inversion <- 'not'* comparison
comparison <- bit (('==' / '!=' / '<=' / '<' / '>=' / '>' / 'not' 'in' / 'in' / 'is' 'not' / 'is') 'not'* bit)*
bit <- factor (('|' / '^' / '&' / '<<' / '>>' / '+' / '-' / '*' / '/' / '//' / '%' / '@') factor)*
factor <- ('+' / '-' / '~') factor / 'await'? atom suffix* ('**' factor)?
suffix <- '.' ID / '(' args? ')' / '[' slices ']'
slices <- slice (',' slice)* ','?
slice <- expr? ':' expr? (':' expr?)? / star_named
args <- ID ':=' expr comprehension !',' / !(ID '=') expr comprehension ','? &')' / arg (',' arg)* ','?
arg <- '**' expr / '*' expr / ID '=' expr / named
comprehension <- ('async'? 'for' for_targets 'in' disjunction ('if' disjunction)*)+
atom <- ID / (STR / fstring)+ / NUM / 'None' / 'True' / 'False' / '...' / '(' (yield / named comprehension / star_named (',' star_named)* ','?)? ')' / '[' (named comprehension / star_named (',' star_named)* ','?)? ']' / dict
dict <- '{' '}' / '{' (expr ':' expr comprehension / pair (',' pair)* ','? / named comprehension / star_named (',' star_named)* ','?) '}'
pair <- '**' bit / expr ':' expr
fstring <- FSTART field* FEND
field <- '{' (yield / star_exprs) FEQ? FCONV? (FSPEC field*)? '}'
"""

C = r"""
file <- external* EOF
external <- ';' / assert / assembly ';' / function / declaration
assembly <- ('asm' / '__asm__') ('volatile' / '__volatile__' / 'goto' / 'inline')* '(' (!')' (paren_any / any))* ')'
paren_any <- '(' (!')' (paren_any / any))* ')'
any <- !('(' / ')') (ID / NUM / STR / CHAR / ',' / ':' / ';' / '[' / ']' / '{' / '}' / '+' / '-' / '*' / '/' / '&' / '=' / '%' / '|' / '<' / '>' / '!' / '~' / '.' / '->' / 'sizeof' / type_word)
attribute <- '__attribute__' paren_any / '__extension__' / '_Alignas' paren_any / '[' '[' (!']' (ID / ',' / ':' / paren_any))* ']' ']'
assert <- '_Static_assert' '(' cond (',' STR+)? ')' ';'
function <- specs ('*' qualifier*)* attribute* (ID &'(' / '(' attribute* declarator ')') tail* attribute* declaration* compound
qualifier <- 'const' / 'volatile' / 'restrict' / '__restrict' / '_Atomic' !'(' / attribute
storage <- 'typedef' / 'extern' / 'static' / '_Thread_local' / 'auto' / 'register' / 'inline' / '__inline' / '__inline__' / '_Noreturn'
type_word <- 'void' / 'char' / 'short' / 'int' / 'long' / 'float' / 'double' / 'signed' / 'unsigned' / '_Bool' / '_Complex'
specs <- (storage / qualifier)* (type_word (type_word / storage / qualifier)* / (struct / enum / typeof / '_Atomic' '(' type_name ')' / ID) (storage / qualifier)*)
spec_quals <- qualifier* (type_word (type_word / qualifier)* / (struct / enum / typeof / '_Atomic' '(' type_name ')' / ID) qualifier*)
typeof <- ('typeof' / '__typeof__') '(' (type_name / expr) ')'
struct <- ('struct' / 'union') attribute* (ID? '{' (member / assert)* '}' attribute* / ID)
member <- spec_quals (field (',' field)*)? attribute* ';' / ';'
field <- declarator (':' cond)? attribute* / ':' cond
enum <- 'enum' attribute* (ID? '{' enumerator (',' enumerator)* ','? '}' attribute* / ID)
enumerator <- ID attribute* ('=' cond)?
declaration <- specs (init_declarator (',' init_declarator)*)? ';'
init_declarator <- declarator assembly? attribute* ('=' initializer)?
initializer <- '{' (item (',' item)*)? ','? '}' / assignment
item <- ((('[' cond ('...' cond)? ']' / '.' ID)+ '=') / ID ':')? initializer
declarator <- ('*' qualifier*)* attribute* (ID / '(' attribute* declarator ')') tail*
tail <- '[' ('static' / qualifier / '*' &']')* assignment? ']' / '(' params? ')' attribute*
params <- '...' / param (',' param)* (',' '...')?
param <- specs (declarator / abstract)? attribute*
abstract <- ('*' qualifier*)+ direct_abstract? / direct_abstract
direct_abstract <- ('(' abstract ')' / tail) tail*
type_name <- spec_quals abstract?
compound <- '{' (label_names / assert / declaration / stmt)* '}'
label_names <- "__label__" ID (',' ID)* ';'
stmt <- compound / ';' / 'if' paren stmt ('else' stmt)? / 'switch' paren stmt / 'while' paren stmt / 'do' stmt 'while' paren ';' / 'for' '(' (declaration / expr? ';') expr? ';' expr? ')' stmt
    / 'goto' (ID / '*' expr) ';' / 'continue' ';' / 'break' ';' / 'return' expr? ';' / assembly ';' / ID ':' attribute* (stmt / declaration / &'}') / 'case' cond ('...' cond)? ':' (stmt / declaration / &'}') / 'default' ':' (stmt / declaration / &'}') / attribute+ ';' / expr ';'
paren <- '(' expr ')'
expr <- assignment (',' assignment)*
assignment <- cond (assign_op assignment)?
assign_op <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>='
cond <- binary ('?' expr? ':' cond)?
binary <- cast (('||' / '&&' / '|' / '^' / '&' / '==' / '!=' / '<=' / '>=' / '<<' / '>>' / '<' / '>' / '+' / '-' / '*' / '/' / '%') cast)*
cast <- '(' type_name ')' ('{' (item (',' item)*)? ','? '}' suffix* / cast) / unary
unary <- ('++' / '--') unary / ('&&' ID) / ('&' / '*' / '+' / '-' / '~' / '!' / '__extension__') cast / ('sizeof' / '_Alignof') ('(' type_name ')' !'{' / unary) / primary suffix*
primary <- ID / NUM / CHAR / (STR / ID &STR)+ / '(' compound ')' / paren / '_Generic' '(' assignment (',' ('default' / type_name) ':' assignment)+ ')'
suffix <- '[' expr ']' / '(' (argument (',' argument)*)? ')' / '.' ID / '->' ID / '++' / '--'
argument <- assignment / type_name
"""

CPP = r"""
file <- decl* EOF
attr <- '[' '[' (!(']' ']') soup)* ']' ']' / 'alignas' '(' (!')' soup)* ')' / '__attribute__' '(' (!')' soup)* ')'
soup <- '(' (!')' soup)* ')' / '[' (!']' soup)* ']' / ID / NUM / STR / CHAR / ',' / ':' / '::' / '...' / '=' / '*' / '&' / '<' / '>' / '+' / '-' / 'const' / 'int' / 'using'
decl <- ';' / namespace / using / template / 'extern' STR ('{' decl* '}' / decl) / assert / asm / alias / concept / function / simple
namespace <- 'inline'? 'namespace' attr* ('inline'? ID ('::' 'inline'? ID)*)? ('{' decl* '}' / '=' qualified ';')
using <- 'using' 'namespace' attr* qualified ';' / 'using' 'enum' qualified ';' / 'using' 'typename'? using_name (',' 'typename'? using_name)* ';'
using_name <- qualified '...'?
alias <- 'using' ID attr* '=' type_id ';'
assert <- 'static_assert' '(' cond (',' STR+)? ')' ';'
asm <- 'asm' 'volatile'? '(' (!')' soup)* ')' ';'
template <- 'extern'? 'template' ('<' (tparam (',' tparam)*)? close requires?)? (template / friend / alias / concept / function / simple)
tparam <- 'template' '<' (tparam (',' tparam)*)? close ('typename' / 'class') '...'? ID? ('=' type_id)? / ('typename' / 'class') '...'? ID? ('=' type_id)? !('::' / '<') / specs pack_declarator? ('=' no_gt)?
pack_declarator <- '...' ID? / declarator / abstract
concept <- 'concept' ID '=' cond ';'
requires <- 'requires' req_or
req_or <- req_primary (('||' / '&&') req_primary)*
req_primary <- requires_expr / paren / qualified / 'true' / 'false'
requires_expr <- 'requires' ('(' params? ')')? '{' requirement* '}'
requirement <- 'typename' qualified ';' / '{' expr '}' 'noexcept'? ('->' qualified)? ';' / 'requires' cond ';' / expr ';'
close <- '>' / G
targs <- '<' (targ (',' targ)*)? close
targ <- type_id '...'? &(',' / '>' / G) / no_gt '...'?
no_gt <- cast (('||' / '&&' / '|' / '^' / '&' / '==' / '!=' / '<=' / '>=' / '<<' / '<' / '+' / '-' / '*' / '/' / '%') cast)*
nested <- '::'? (ID targs? '::' 'template'?)+ / '::'
qualified <- nested? (ID targs / ID)
id_name <- nested? ('operator' operator_name targs? / '~' ID / ID targs &('(' / '=' / ';' / '{' / ',' / ':') / ID)
operator_name <- '(' ')' / '[' ']' / ('new' / 'delete') ('[' ']')? / STR ID? / 'co_await' / G '>=' / G '>' / '>=' / '<=>' / '<<=' / '->*' / '->' / '++' / '--' / '&&' / '||' / '==' / '!=' / '<=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<' / '+' / '-' / '*' / '/' / '%' / '^' / '&' / '|' / '~' / '!' / '=' / '<' / '>' / ',' / specs ptr*
type_word <- 'void' / 'bool' / 'char' / 'char8_t' / 'char16_t' / 'char32_t' / 'wchar_t' / 'short' / 'int' / 'long' / 'float' / 'double' / 'signed' / 'unsigned'
cv <- 'const' / 'volatile' / attr
flag <- 'static' / 'inline' / 'virtual' / 'explicit' ('(' cond ')')? / 'friend' / 'constexpr' / 'consteval' / 'constinit' / 'mutable' / 'extern' / 'thread_local' / 'register' / 'typedef' / cv
specs <- flag* (type_word (type_word / flag)* / (class / enum / 'decltype' '(' (expr / 'auto') ')' ('::' qualified)? / 'auto' / 'typename' nested 'template'? qualified / qualified 'auto'?) flag*)
class <- ('class' / 'struct' / 'union') attr* (class_name? "final"? (':' base (',' base)*)? '{' member* '}' / class_name / 'enum')
class_name <- nested? ID targs?
base <- attr* ('virtual' / 'public' / 'protected' / 'private')* (qualified / 'decltype' paren) '...'?
enum <- 'enum' ('class' / 'struct')? attr* (qualified? (':' specs)? '{' (enumerator (',' enumerator)*)? ','? '}' / qualified (':' specs)?)
enumerator <- ID attr* ('=' cond)?
member <- ('public' / 'protected' / 'private') ':' / ';' / friend / using / alias / assert / template / function / bit_field / simple
friend <- 'friend' (function / simple / specs ';')
bit_field <- specs ID? ':' cond ('=' init)? (',' ID ':' cond)* ';'
simple <- attr* specs (init_declarator (',' init_declarator)*)? ';' / attr* specs ('&' / '&&')? '[' ID (',' ID)* ']' init_part ';' / flag+ id_name '(' params? ')' trailer* ';' / id_name '(' params? ')' trailer* pure? ';' 
init_declarator <- declarator ('=' init / brace / '(' (arg (',' arg)*)? ')')? requires? / declarator pure
pure <- '=' ('default' / 'delete' / NUM)
init_part <- '=' init / brace / '(' expr ')'
init <- brace / assignment
brace <- '{' (brace_item (',' brace_item)*)? ','? '}'
brace_item <- ('.' ID ('=' init / brace)) / init '...'?
ptr <- ('*' / '&&' / '&' / nested '*') cv*
declarator <- ptr* attr* (id_name / '...' ID / '(' declarator ')') attr* tail*
tail <- '[' cond? ']' / '(' params? ')' trailer*
trailer <- 'const' / 'volatile' / '&&' / '&' / 'noexcept' ('(' cond ')')? / 'throw' '(' (type_id (',' type_id)*)? ')' / '->' type_id / "override" / "final" / attr / requires
params <- '...' / param (',' param)* ','? '...'?
param <- attr* 'this'? specs (declarator / abstract / '...' ID?)? ('=' init)?
abstract <- ptr+ '...'? direct_abstract? / direct_abstract
direct_abstract <- ('(' abstract ')' / tail) tail*
type_id <- specs abstract?
function <- attr* (specs fn_declarator / flag* fn_name) (ctor_init? compound / '=' ('default' / 'delete') ';' / 'try' ctor_init? compound handler+)
fn_declarator <- ptr* attr* id_name '(' params? ')' trailer* tail*
fn_name <- id_name '(' params? ')' trailer*
ctor_init <- ':' mem_init (',' mem_init)*
mem_init <- qualified (brace / '(' (arg (',' arg)*)? ')') '...'?
compound <- '{' stmt* '}'
handler <- 'catch' '(' ('...' / param) ')' compound
stmt <- attr* (compound / ';' / 'if' ('constexpr' / '!'? "consteval")? condition stmt ('else' stmt)? / 'switch' condition stmt / 'while' condition stmt / 'do' stmt 'while' paren ';' / for / 'goto' ID ';' / 'continue' ';' / 'break' ';'
    / ('return' / 'co_return') init? ';' / 'try' compound handler+ / 'case' cond ('...' cond)? ':' (stmt / &'}') / 'default' ':' (stmt / &'}') / ID ':' !':' (stmt / &'}') / using / alias / assert / asm / namespace / decl_stmt / expr ';')
decl_stmt <- !('co_yield' / 'co_await' / 'throw' / 'delete') local
local <- attr* specs (init_declarator (',' init_declarator)*) ';' / attr* specs ('&' / '&&')? '[' ID (',' ID)* ']' init_part ';' / flag* (class / enum) flag* ';'
condition <- '(' (for_init)? (specs declarator init_part / expr) ')'
for_init <- (local / expr? ';')
for <- 'for' '(' (for_init? specs ptr* ('[' ID (',' ID)* ']' / ID) ':' init ')' / for_init (specs declarator init_part / expr)? ';' expr? ')') stmt
paren <- '(' expr ')'
expr <- assignment (',' assignment)*
assignment <- 'throw' assignment? / 'co_yield' init / cond (assign_op init)?
assign_op <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / G '>='
cond <- binary ('?' expr ':' assignment)?
binary <- cast (('||' / '&&' / '|' / '^' / '&' / '==' / '!=' / '<=>' / '<=' / '>=' / '<<' / '<' / G '>' / '>' / '+' / '-' / '*' / '/' / '%' / '.*' / '->*' / '...') cast / '...' &')')*
cast <- '(' type_id ')' !(';' / ',' / ')' / ':') cast_operand / unary
cast_operand <- !('+' / '-' / '*' / '&' / '[' / '(') cast / '(' type_id ')' cast_operand / ('*' / '&' / '-' / '+') cast / paren suffix*
unary <- ('++' / '--') unary / ('&' / '*' / '+' / '-' / '~' / '!' / 'co_await') cast / 'sizeof' '...' '(' ID ')' / ('sizeof' / 'alignof') ('(' type_id ')' / unary) / 'noexcept' paren / new / '::'? 'delete' ('[' ']')? cast / primary suffix*
new <- '::'? 'new' ('(' (arg (',' arg)*)? ')')? ('(' type_id ')' / specs ptr* ('[' expr? ']')*) ('(' (arg (',' arg)*)? ')' / brace)?
primary <- NUM / CHAR / (STR / ID &STR)+ / 'true' / 'false' / 'nullptr' / 'this' / lambda / requires_expr / fold / paren / ('static_cast' / 'dynamic_cast' / 'const_cast' / 'reinterpret_cast') '<' type_id close paren
    / 'typeid' '(' (type_id / expr) ')' / type_word+ ('(' (arg (',' arg)*)? ')' / brace) / 'typename' nested 'template'? qualified ('(' (arg (',' arg)*)? ')' / brace) / 'decltype' paren ('(' (arg (',' arg)*)? ')' / brace) / 'auto' ('(' expr ')' / brace) / name
fold <- '(' '...' ('||' / '&&' / '|' / '^' / '&' / '<<' / '+' / '-' / '*' / '/' / ',') cast ')' / '(' cast (',' / '||' / '&&' / '+' / '*' / '<<') '...' ')'
name <- nested? ('operator' operator_name / '~' ID / ID targs &('(' / '{' / ')' / ',' / ';' / '::' / '>' / ']' / '}') / ID) (brace &(!'{'))?
lambda <- '[' (capture (',' capture)*)? ']' ('<' (tparam (',' tparam)*)? close requires?)? ('(' params? ')')? ('mutable' / 'constexpr' / 'static' / trailer)* compound
capture <- '&' (ID ('=' init / '...')?)? / '=' / '*'? 'this' / '...'? ID ('...' / '=' init / brace)?
suffix <- '[' expr ']' / '[' brace ']' / '(' (arg (',' arg)*)? ')' / ('.' / '->') 'template'? (nested? ('operator' operator_name / '~' ID / ID targs &'(' / ID)) / '++' / '--'
arg <- init '...'? / type_id
"""
